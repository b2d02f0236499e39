"""Peaks in rounds against the literal loop: ties, ranges, borders, chains, many peaks."""

import random

import pytest

from crestline.operators import rounds as R
from crestline.operators.peaks import select_peaks
from crestline.params import DetectParams


def loop(found, sep, k=10**9):
    """Take the best of a series, drop what is around it, repeat."""
    out = []
    for series in {s for s, _, _ in found}:
        left, rank = {t: x for s, t, x in found if s == series}, 0
        while left and rank < k:
            best = min(left, key=lambda t: (-left[t], t))
            rank += 1
            out.append((series, rank, best, left[best]))
            left = {t: x for t, x in left.items() if not best - sep <= t < best + sep}
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.series_id, r.rank, r.second, r.score) for r in frame.collect()), key=str)


def framed(spark, found):
    return spark.createDataFrame(found, "series_id string, second bigint, score double").repartition(4)


@pytest.mark.parametrize(("seed", "stretch"), [(1, 31), (2, 64), (3, 100), (4, 1_000), (5, 50)])
def test_rounds_are_the_loop(spark, seed, stretch):
    """Few different scores, so ties and neighbours exactly the separation apart are frequent; stretches cut everywhere."""
    rng = random.Random(seed)
    found = [(s, t, float(rng.choice([2, 2, 3, 5, 9]))) for s in ("a", "b", None) for t in range(600) if rng.random() < 0.7]
    p = DetectParams(k=10**6, duration=15, gap=0)
    assert got(R.many_peaks(framed(spark, found), p, stretch)) == loop(found, 15)


def test_half_open_range(spark):
    p = DetectParams(k=10**6, duration=15, gap=0)
    for found in ([("a", 0, 2.0), ("a", 15, 3.0)], [("a", 0, 3.0), ("a", 15, 2.0)], [("a", 0, 2.0), ("a", 16, 3.0)], [("a", 5, 2.0), ("a", 5, 2.0)]):
        want = loop(found, 15)
        assert got(R.many_peaks(framed(spark, found), p)) == want


def test_a_rising_series_goes_on_from_stretch_to_stretch(spark):
    """Every candidate waits for a better one after it, through all stretches."""
    found = [("a", t, 2.0 + t / 1000) for t in range(400)]
    p = DetectParams(k=10**6, duration=15, gap=0)
    assert got(R.many_peaks(framed(spark, found), p, 60)) == loop(found, 15)


def test_hundred_thousand_peaks_of_one_series(spark):
    """k = 10^5 on one series; no task sees more than a stretch of it, and the first few are those of the one-plan form."""
    found = spark.range(0, 4_000_000, 1, 8).selectExpr("'a' AS series_id", "id AS second", "CAST(2 + pmod(hash(id), 1009) AS double) AS score")
    p = DetectParams(k=100_000, duration=15, gap=0)
    peaks = R.many_peaks(found, p).cache()
    assert peaks.count() == 100_000
    at = sorted(r.second for r in R.all_peaks(found, p).collect())
    assert len(at) > 130_000 and all(b - a >= 15 for a, b in zip(at, at[1:])) and all(b - a <= 30 for a, b in zip(at, at[1:]))
    few = DetectParams(k=20, duration=15, gap=0)
    assert got(peaks.where("rank <= 20")) == got(select_peaks(found, few))
    peaks.unpersist()


def test_which_form(spark):
    assert R.chosen_peaks(framed(spark, []), DetectParams(k=R.FEW + 1)).collect() == []
    found = [("a", t, float(t * 7919 % 101)) for t in range(3_000)] + [("a", None, 5.0), ("b", 3, None)]
    some = [x for x in found if None not in x]
    for k in (R.FEW, R.FEW + 1):
        p = DetectParams(k=k, duration=15, gap=0)
        assert got(R.chosen_peaks(framed(spark, found if k > R.FEW else some), p)) == loop(some, 15, k)
