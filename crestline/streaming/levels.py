"""The stages that work on endless input: maxima per bucket, and throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from crestline.operators.lines import numbers, rising
from crestline.params import DetectParams


def bucket_stream(samples: DataFrame, p: DetectParams = DetectParams(), ts: str = "ts", origin: str = "2024-01-01 00:00:00", late: str = "1 minute") -> DataFrame:
    """(series_id, second, level) of a stream of (series_id, ts, level), each bucket once it can't change any more.

    The state is one maximum per open bucket. Samples later than the watermark
    ``late`` are left out; with all input in time the result is that of the batch
    stage. Smoothing and the baseline need whole series and follow in batch, for
    instance in ``foreachBatch``.
    """
    width = f"{round(p.bucket_seconds * 1_000_000)} microseconds"
    start = F.expr(f"TIMESTAMP '{origin}'")
    timed = samples.withColumn("_at", F.col(ts).cast("timestamp")).where(F.col("_at") >= start).withWatermark("_at", late)
    top = timed.groupBy("series_id", F.window("_at", width).alias("w")).agg(F.greatest(F.max("level"), F.lit(p.floor)).alias("level"))
    second = F.floor((F.unix_micros(F.col("w.start")) - F.unix_micros(start)) / round(p.bucket_seconds * 1_000_000)).cast("bigint")
    return top.select("series_id", second.alias("second"), "level")


def keep_buckets(buckets: DataFrame, folder: str) -> DataFrame:
    """Run a stream of buckets to the end of its present input into Parquet, and read the buckets back.

    Each batch writes the buckets it has changed, in a folder of its number, so a
    batch that is repeated after a failure replaces what it wrote. A bucket's level
    only rises, so of its versions the highest holds. State is kept until the
    watermark passes; nothing goes through the driver.
    """
    spark = buckets.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/buckets/batch={number}")

    query = buckets.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema(buckets.schema).parquet(f"{folder}/buckets")
    return kept.groupBy("series_id", "second").agg(F.max("level").alias("level"))


class _Throttle(StatefulProcessor):
    """A key's last report, in a value state that goes when nothing has come for ``idle`` seconds of processing time."""

    def __init__(self, step: float, start: float, idle: float | None):
        self.step, self.start, self.idle = step, start, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last double", None if self.idle is None else int(self.idle * 1_000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else self.start
        for o, v in sorted((r.o, r.v) for r in rows):
            if v - last >= self.step:
                last = v
                yield Row(k=key[0], o=o, v=v)
        self.last.update((last,))

    def close(self) -> None:
        pass


def _rising_of_batches(batches):
    """Each Arrow batch's rows that are above all earlier ones of their key in it; only these can be reported."""
    for batch in batches:
        ordered = batch.take(pc.sort_indices(batch, sort_keys=[("k", "ascending"), ("o", "ascending"), ("v", "ascending")]))
        yield from rising([ordered])


def rocksdb_state(spark: SparkSession) -> None:
    """Have the session keep state in RocksDB unless another provider than the default, which can't hold typed state, was chosen."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(provider).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def throttle_stream(values: DataFrame, key: str, order: str, value: str, step: float = 10.0, start: float = -10.0, idle: float | None = None) -> DataFrame:
    """(key, order, value) of a stream's rows that are at least ``step`` above the last one reported of their key.

    The state is one number per key, dropped after ``idle`` seconds without a row if that
    is given; the key then starts anew. Rows of a micro-batch are taken in ``order``; of
    each Arrow batch only those above all earlier ones of their key come to the state, so
    few of a key's rows are ever sorted in memory. Values that are null or no number
    report nothing. The session must use RocksDB for state, which is set here unless
    another provider was chosen.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    rocksdb_state(values.sparkSession)
    rows = numbers(values, key, order, value).select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    few = rows.mapInArrow(_rising_of_batches, rows.schema)
    mode = "None" if idle is None else "ProcessingTime"
    done = few.groupBy("k").transformWithState(_Throttle(step, start, idle), StructType.fromDDL("k string, o long, v double"), "append", mode)
    return done.toDF(key, order, value)
