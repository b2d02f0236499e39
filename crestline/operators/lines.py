"""Operators over ordered rows: the last few of each group, and a throttle of progress reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tail(rows: DataFrame, key: str, order: str, n: int = 5) -> DataFrame:
    """Each key's last ``n`` rows by ``order``; Spark keeps only ``n`` per key and task before the shuffle."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_from_end", last).where(F.col("_from_end") <= n).drop("_from_end")


def last_or(parts, default: str):
    """An array's last element, or ``default`` for an empty one."""
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(default))


def rising(batches, first: int = 0, value: int = 2, start: float = float("-inf")):
    """Of Arrow batches sorted by key, the rows whose value is above all earlier ones of their key."""
    at, top = None, start
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(first).dictionary_encode()
        keys, v = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), batch.column(value).to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(v)]
        taken = np.zeros(len(v), bool)
        for begin, end in zip(bounds, bounds[1:], strict=False):
            key = None if keys[begin] < 0 else codes.dictionary[int(keys[begin])].as_py()
            before = top if begin == 0 and key == at else start
            highest = np.maximum.accumulate(np.append(before, v[begin:end]))
            taken[begin:end] = v[begin:end] > highest[:-1]
            at, top = key, highest[-1]
        yield batch.filter(pa.array(taken))


def throttled(values: DataFrame, key: str, order: str, value: str, step: float = 10.0, start: float = -10.0) -> DataFrame:
    """(key, order, value) of the rows that are reported: those at least ``step`` above the last one reported.

    A reported row is above all earlier ones of its key. Let v be reported, l the last
    report before it, and u any earlier value. If u was reported, u <= l < v, as reports
    rise by ``step`` at least. If not, u was less than ``step`` above the last report
    before u, which is l at most; so u < l + step <= v. The same holds within any range
    of a key's rows. So ranges of (key, order) are taken apart, however many rows a key
    has, each gives those above all earlier ones in it, and only these are then read
    key by key, in order. Their number is bounded by a key's distinct values in a range,
    not by its rows.

    Rows of one place in the order come by value. Values that are null or no number
    report nothing.
    """
    if step <= 0:
        raise ValueError("step must be positive")

    def run(batches):
        at, last = None, start
        for batch in batches:
            taken = []
            for i, (k, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if k != at:
                    at, last = k, start
                if v - last >= step:
                    taken.append(i)
                    last = v
            yield batch.take(pa.array(taken, pa.int64()))

    rows = numbers(values, key, order, value)
    ranges = rows.repartitionByRange(key, order).sortWithinPartitions(key, order, value).mapInArrow(rising, rows.schema)
    return ranges.repartition(key).sortWithinPartitions(key, order, value).mapInArrow(run, rows.schema)


def numbers(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order as a long, value as a double, of the rows whose value is a number."""
    number = F.col(value).cast("double")
    return values.where(number.isNotNull() & ~F.isnan(number)).select(key, F.col(order).cast("long").alias(order), number.alias(value))
