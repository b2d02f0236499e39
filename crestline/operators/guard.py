"""Why a series is too short: its last lines, found in the same pass as its buckets.

A task reads its lines once and gives two kinds of rows: the maximum of each bucket it
has seen, and of each series the last few lines by their place in the file. Both merge:
the maximum of maxima, the last of last lines. So however long a series, a task passes
on no more than its buckets and a few lines of it, and no task sees a series whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.text import joined_lines, stripped
from crestline.operators.series import observed, seconds_of
from crestline.params import DetectParams
from crestline.shared import written
from crestline.sources.levels import parsed

#: Lines of a series that are kept, blank ones among them.
LAST = 5


def partial_sums(lines: DataFrame, p: DetectParams = DetectParams(), n: int = LAST) -> DataFrame:
    """Of each task: (series_id, second, level) of its buckets, and (series_id, offset, line) of its last ``n`` lines of a series.

    ``lines``: series_id, offset, line.
    """

    def run(batches):
        tails: dict[str | None, list[tuple[int, str | None]]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            top = table.select(["series_id", "second", "level"]).filter(table["level"].is_valid()).group_by(["series_id", "second"]).aggregate([("level", "max")])
            yield _rows(top["series_id"], top["second"], top["level_max"], None, None)
            series, offset = batch.column("series_id").dictionary_encode(), batch.column("offset").to_numpy(zero_copy_only=False)
            code = series.indices.fill_null(len(series.dictionary)).to_numpy(zero_copy_only=False)
            order = np.lexsort((offset, code))
            ends = np.append(np.flatnonzero(np.diff(code[order])), len(order) - 1) if len(order) else []
            begin = 0
            for end in ends:
                last = pa.array(order[max(begin, end - n + 1) : end + 1])
                part = batch.take(last)
                key = part.column("series_id")[0].as_py()
                held = tails.get(key, []) + list(zip(part.column("offset").to_pylist(), part.column("line").to_pylist(), strict=True))
                tails[key] = sorted(held, key=lambda x: x[0])[-n:]
                begin = end + 1
            if len(tails) > 10_000:
                yield from _tails(tails)
                tails = {}
        yield from _tails(tails)

    cleaned = parsed(lines, F.struct("offset", stripped(F.col("line")).alias("line")).alias("of"), floor=p.floor)
    second = seconds_of(F.col("t"), p)
    rows = cleaned.select("series_id", second.alias("second"), F.when(second.isNotNull(), F.greatest("level", F.lit(p.floor))).alias("level"), "of.offset", "of.line")
    return rows.mapInArrow(run, "series_id string, second long, level double, offset long, line string")


def _rows(series, second, level, offset, line) -> pa.RecordBatch:
    types = {"series_id": pa.string(), "second": pa.int64(), "level": pa.float64(), "offset": pa.int64(), "line": pa.string()}
    given = (series, second, level, offset, line)
    n = len(next(x for x in given if x is not None))
    whole = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pa.record_batch([pa.nulls(n, t) if x is None else pa.array(x, t) if isinstance(x, list) else whole(x).cast(t) for x, t in zip(given, types.values(), strict=True)], list(types))


def _tails(tails: dict):
    flat = [(key, offset, line) for key, held in tails.items() for offset, line in held]
    if flat:
        series, offset, line = map(list, zip(*flat, strict=True))
        yield _rows(series, None, None, offset, line)


def guarded(lines: DataFrame, p: DetectParams = DetectParams(), n: int = LAST) -> tuple[DataFrame, DataFrame]:
    """(buckets, states) of lines read once; ``states`` as from ``observed``, with ``detail``.

    ``detail``: of series that are too short, the last ``n`` lines by offset without
    white space around them, blank ones left out, a line each; of others null. Series
    without any level are too short as well and have 0 buckets.

    Cases: a null line is blank; of lines with one offset any order may hold; a null
    series is one; an empty table gives empty results; other columns may have any names.
    """
    sums = written(partial_sums(lines, p, n), "guard")
    buckets = sums.where("second IS NOT NULL").groupBy("series_id", "second").agg(F.max("level").alias("level"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("offset").desc()))
    tails = sums.where("offset IS NOT NULL").withColumn("place", place).where(F.col("place") <= n)
    last = F.transform(F.array_sort(F.collect_list(F.struct("offset", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"])
    detail = tails.groupBy(F.col("series_id").alias("of")).agg(joined_lines(last).alias("detail"))
    states = detail.join(observed(buckets, p), F.col("of").eqNullSafe(F.col("series_id")), "left")
    status = F.coalesce("status", F.lit("too_short"))
    return buckets, states.select(F.col("of").alias("series_id"), F.coalesce("observed", F.lit(0).cast("long")).alias("observed"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), status.alias("status"), F.when(status == "too_short", F.col("detail")).alias("detail"))
