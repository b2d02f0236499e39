"""Smoothing of an endless series: centred means as soon as they can't change, and what came too late.

A bucket is closed once the watermark is past its end. The mean around a second is
emitted when the seconds up to ``half_window`` after it are closed and the series is
known to go on that far, as windows are cut at a series' end. A series without a row
for ``end`` of event time has ended: the rest follows with its cut windows. With all
input in time, what has been emitted by then is the batch stage's result, by runs: a
second within ``half_window`` of an observed bucket is a row, and a gap is one or more.

The state of a series is its open buckets, those before that windows still need, and
two numbers; an event-time timer wakes it when the next mean is due.

Rows for closed buckets, or of a series that has ended, don't change what was emitted.
They come out too, as ``late``: the bucket, the highest level, and how many rows they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from crestline.params import DetectParams
from crestline.streaming.levels import rocksdb_state

OUT = "series_id string, kind string, first bigint, last bigint, level double, n_rows bigint"


def _loudest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch one row for each bucket, so that few of a series' rows come to its state."""
    for batch in batches:
        found = pa.table(batch).group_by(["series_id", "second"]).aggregate([("level", "max"), ("level", "count")])
        found = found.rename_columns(["series_id", "second", "level", "n_rows"])
        yield from found.to_batches()


class _Smoother(StatefulProcessor):
    def __init__(self, p: DetectParams, origin_ms: int, end_ms: int):
        self.p, self.origin, self.end, self.width = p, origin_ms, end_ms, p.bucket_seconds * 1_000

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "second long", "level double")
        self.place = handle.getValueState("place", "next long, last long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        begin, last, ended = self.place.get() if self.place.exists() else (0, -1, False)
        closed = self._closed(timerValues)
        for r in rows:
            if ended or r.second < closed:
                yield Row(series_id=key[0], kind="late", first=r.second, last=r.second, level=r.level, n_rows=r.n_rows)
                continue
            at = (r.second,)
            level = max(r.level, self.levels.getValue(at)[0]) if self.levels.containsKey(at) else max(r.level, self.p.floor)
            self.levels.updateValue(at, (level,))
            last = max(last, r.second)
        if last >= 0:
            yield from self._due(key, begin, last, ended, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._due(key, *self.place.get(), timerValues)

    def close(self) -> None:
        pass

    def _closed(self, timerValues) -> int:
        """How many buckets from the first on are closed."""
        return max(0, math.floor((timerValues.getCurrentWatermarkInMs() - self.origin) / self.width))

    def _at(self, bucket: int, more: int = 0) -> int:
        """The watermark from which on a bucket is closed, in milliseconds."""
        return math.ceil(self.origin + (bucket + 1) * self.width) + more

    def _due(self, key, begin, last, ended, timerValues) -> Iterator[Row]:
        """The means that are due, and the timer for the next."""
        h, now = self.p.half_window, timerValues.getCurrentWatermarkInMs()
        over = not ended and now >= self._at(last, self.end)
        stop = last + 1 if over else min(self._closed(timerValues), last + 1) - h
        if not ended and stop > begin:
            held = {k[0]: v[0] for k, v in self.levels.iterator()}
            for first, to, mean in means(held, begin, stop, last + 1 if over else None, self.p):
                yield Row(series_id=key[0], kind="mean", first=first, last=to, level=mean, n_rows=None)
            begin = stop
            for second in [s for s in held if s < begin - h or over]:
                self.levels.removeKey((second,))
        self.place.update((begin, last, ended or over))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if not (ended or over):
            self.handle.registerTimer(max(now + 1, self._at(begin + h) if begin + h <= last else self._at(last, self.end)))


def means(held: dict[int, float], begin: int, stop: int, n: int | None, p: DetectParams) -> Iterator[tuple[int, int, float]]:
    """(first, last, mean) of the seconds from ``begin`` to before ``stop`` of a series of ``n`` seconds, None: it goes on.

    ``held``: the levels of all observed buckets in their windows; others are at the floor.
    """
    h = p.half_window
    unit = 1 if p.decimals is None else 10**p.decimals
    exact = (lambda x: x) if p.decimals is None else (lambda x: int(math.copysign(math.floor(abs(x * unit) + 0.5), x)))
    low = exact(p.floor)
    at = begin
    for second in [*sorted(s for s in held if begin - h <= s < stop + h), stop + h]:
        if (free := min(second - h, stop)) > at:  # a gap, in which all windows are at the floor
            yield at, free - 1, low / unit
            at = free
        while at < min(second + h + 1, stop):
            window = range(max(0, at - h), at + h + 1 if n is None else min(n, at + h + 1))
            total = sum(exact(held[s]) if s in held else low for s in window)
            yield at, at, (round(total / len(window), 9) if p.decimals is None else total / (len(window) * unit))
            at += 1


def smooth_stream(samples: DataFrame, p: DetectParams = DetectParams(), ts: str = "ts", origin: str = "2024-01-01 00:00:00", late: str = "1 minute", end: float = 3_600) -> DataFrame:
    """A stream of (series_id, kind, first, last, level, n_rows) from one of (series_id, ts, level).

    kind ``mean``: the smoothed level of the seconds from first to last. kind ``late``:
    ``n_rows`` rows, ``level`` the highest, that came when their bucket was closed.
    ``late`` is the watermark's delay, ``end`` the seconds after which a series has ended.
    Rows without a time or a level, or from before the origin, are left out; a null
    series is one. The mode is append, and the session must use RocksDB for state.
    """
    if end < 0:
        raise ValueError("end must not be negative")
    spark = samples.sparkSession
    rocksdb_state(spark)
    start = F.expr(f"TIMESTAMP '{origin}'")
    origin_ms = spark.range(1).select(F.unix_millis(start)).first()[0]
    second = F.floor((F.unix_micros("_at") - F.unix_micros(start)) / round(p.bucket_seconds * 1_000_000)).cast("bigint")
    timed = samples.withColumn("_at", F.col(ts).cast("timestamp")).where((F.col("_at") >= start) & F.col("level").isNotNull()).withWatermark("_at", late)
    # rows go on without their time, by which Spark would drop those behind the watermark unseen
    rows = timed.select(F.col("series_id").cast("string").alias("series_id"), second.alias("second"), F.col("level").cast("double").alias("level"))
    few = rows.mapInArrow(_loudest, "series_id string, second bigint, level double, n_rows bigint")
    return few.groupBy("series_id").transformWithState(_Smoother(p, origin_ms, round(end * 1_000)), StructType.fromDDL(OUT), "append", "EventTime")


def keep_smoothed(stream: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream of ``smooth_stream`` to the end of its present input into Parquet; (means by runs, the table of late rows).

    Called again with the same folder it goes on where it was. A batch that is repeated
    after a failure replaces what it wrote.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(OUT).parquet(f"{folder}/out")
    means_ = kept.where("kind = 'mean'").select("series_id", "first", "last", F.col("level").alias("smoothed"))
    return means_, kept.where("kind = 'late'").select("series_id", F.col("first").alias("second"), "level", "n_rows")
