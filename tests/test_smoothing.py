"""Smoothing of a stream: the batch stage's means, restarts, late rows, ended series."""

import datetime as dt
import random

import pytest

from crestline.operators import series as S
from crestline.params import DetectParams
from crestline.streaming.smoothing import keep_smoothed, means, smooth_stream

SCHEMA = "series_id string, ts timestamp, level double"
ORIGIN = dt.datetime(2024, 1, 1)
P = DetectParams(decimals=1)


def at(second):
    return ORIGIN + dt.timedelta(seconds=second)


def batch(spark, rows):
    """The batch stage over (series, second, level); it joins by series, so the null one has a name there."""
    frame = spark.createDataFrame([(s or "null", float(t), x) for s, t, x in rows], "series_id string, t double, level double")
    return {(None if r.series_id == "null" else r.series_id, r.second): r.smoothed for r in S.smooth(S.densify(S.bucket_max(frame, P), P), P).collect()}


def spread(frame):
    out = [(r.series_id, t, r.smoothed) for r in frame.collect() for t in range(r.first, r.last + 1)]
    found = {(s, t): x for s, t, x in out}
    assert len(found) == len(out)  # each second once
    return found


class Runs:
    """A stream of the files in a folder, run from one checkpoint as files come."""

    def __init__(self, spark, folder, **more):
        self.spark, self.folder, self.more, self.n = spark, folder, more, 0
        (folder / "in").mkdir()

    def __call__(self, rows):
        frame = self.spark.createDataFrame([(s, at(t), x) for s, t, x in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(f"file://{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{self.folder}/in")
        return keep_smoothed(smooth_stream(stream, P, **self.more), f"file://{self.folder}/state")


@pytest.mark.parametrize("seed", range(3))
def test_means_in_pieces(spark, seed):
    """Emitted in any pieces, the means are those of the whole."""
    rng = random.Random(seed)
    held = {t: rng.randrange(-400, 0) / 10 for t in sorted(rng.sample(range(400), 40))}
    n, cuts = max(held) + 1, sorted(rng.sample(range(1, max(held)), 9))
    got = [(t, m) for a, b in zip([0, *cuts], [*cuts, n]) for first, last, m in means(held, a, b, n, P) for t in range(first, last + 1)]
    assert got == [(t, x) for (_, t), x in sorted(batch(spark, [("a", t, x) for t, x in held.items()]).items())]


def test_in_time_input_gives_the_batch_stage(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, t + rng.random(), rng.randrange(-800, 0) / 10) for s in ("a", "b", None) for t in range(300) if rng.random() < 0.2 for _ in range(2)]
    run, parts = Runs(spark, tmp_path, late="10 seconds", end=60), 3
    for i in range(parts):
        rest = [r for r in rows if i * 100 <= r[1] < (i + 1) * 100]
        rng.shuffle(rest)
        some, _ = run(rest)
    want = batch(spark, rows)
    early = spread(some)
    assert early.items() <= want.items() and 0 < len(early) < len(want)
    found, late = run([("z", 10_000.0, -1.0)])
    assert spread(found.where("series_id IS DISTINCT FROM 'z'")) == want
    assert late.count() == 0


def test_late_rows_are_in_the_side_table(spark, tmp_path):
    run = Runs(spark, tmp_path, late="10 seconds", end=10_000)
    run([("a", 0.0, -9.0), ("a", 100.0, -8.0)])
    run([("a", 50.0, -1.0), ("a", 50.5, -2.0), ("b", 20.0, -3.0), ("a", 95.0, -4.0), ("a", 200.0, -5.0)])
    found, late = run([("a", 80.0, -6.0), ("c", 300.0, -7.0)])
    assert sorted(map(tuple, late.collect())) == [("a", 50, -1.0, 2), ("a", 80, -6.0, 1), ("b", 20, -3.0, 1)]
    want = batch(spark, [("a", 0, -9.0), ("a", 95, -4.0), ("a", 100, -8.0), ("a", 200, -5.0), ("c", 300, -7.0)])
    got = spread(found)
    assert got.items() <= want.items() and set(got) >= {("a", t) for t in range(100)} and not any(s == "b" for s, _ in got)


def test_an_ended_series_takes_no_more(spark, tmp_path):
    run = Runs(spark, tmp_path, late="0 seconds", end=20)
    run([("a", 5.0, -9.0)])
    run([("b", 100.0, -9.0)])
    found, late = run([("a", 150.0, -2.0), ("a", 151.0, None)])
    assert [tuple(r) for r in late.collect()] == [("a", 150, -2.0, 1)]
    assert {k: x for k, x in spread(found).items() if k[0] == "a"} == batch(spark, [("a", 5, -9.0)])


def test_end_is_checked(spark):
    with pytest.raises(ValueError, match="negative"):
        smooth_stream(spark.createDataFrame([], SCHEMA), end=-1)
