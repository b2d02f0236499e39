"""Peaks from SQL: the table function and the function of an array, against the loop of test_highlights."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from crestline.functions.sql import PickPeaks, register
from crestline.operators import series as S
from crestline.operators.peaks import select_peaks
from crestline.params import DetectParams
from test_highlights import flat, greedy


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    return spark


def test_table_function_equals_the_peaks(sql):
    rng = random.Random(4)
    rows = [(s, t, float(rng.choice([0, 0, 0, 1, 2, 5, 9])), "x") for s in ("a", "b", None) for t in range(700)] + [("short", t, 1.0, "x") for t in range(5)]
    levels = sql.createDataFrame(rows, "series_id string, second bigint, smoothed double, rank string").repartition(5)
    p = DetectParams(k=4, duration=30)
    scored = S.scored(levels.where("series_id IS NOT NULL"))
    got = sql.sql("SELECT * FROM pick_peaks(TABLE({scored}), k => 4, duration => 30)", scored=scored)
    assert got.columns == ["series_id", "rank", "second", "score"]
    want = select_peaks(S.candidates(scored, p), p)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 8


def test_table_function_of_odd_rows(sql):
    rows = [(None, 50, 9.0, 100, 1), (None, 50, 9.0, 100, 2), ("a", None, 9.0, 100, 3), ("a", 50, None, 100, 4), ("b", 2, 9.0, 100, 5), ("b", 40, float("nan"), 100, 6), ("b", 10, 3.0, 100, 7)]
    scored = sql.createDataFrame(rows, "series_id string, second bigint, score double, n bigint, rank int")
    got = sql.sql("SELECT * FROM pick_peaks(TABLE({s}))", s=scored).collect()
    assert sorted(map(tuple, got), key=str) == [("b", 1, 10, 3.0), (None, 1, 50, 9.0)]
    assert sql.sql("SELECT * FROM pick_peaks(TABLE({s}))", s=scored.limit(0)).collect() == []


def test_a_partition_is_not_held():
    picker = PickPeaks()
    for second in range(20_000):
        picker.eval({"series_id": "a", "second": second, "score": 2.0 + second * 7919 % 1009, "n": 20_000}, 3, 15)
    assert len(picker.best) == DetectParams(k=3, duration=15).most_candidates
    assert [r[1] for r in picker.terminate()] == [1, 2, 3]


@pytest.mark.parametrize("call", ["k => 0", "duration => 14", "k => 'six'"])
def test_parameters_are_checked_at_plan_time(sql, call):
    scored = sql.createDataFrame([("a", 1, 2.0, 3)], "series_id string, second bigint, score double, n bigint")
    with pytest.raises(PySparkException):
        sql.sql(f"SELECT * FROM pick_peaks(TABLE({{s}}), {call})", s=scored)
    with pytest.raises(PySparkException, match="no column n"):
        sql.sql("SELECT * FROM pick_peaks(TABLE({s}))", s=scored.drop("n"))


def test_function_of_an_array(sql):
    rng = random.Random(5)
    cases = [flat(_100=-3.0, _220=-5.0), flat(100), [0.0, 0.0, 10.0, 10.0], flat(_29=-3.0), flat(_30=-3.0), flat(_270=-3.0), flat(9, _0=-3.0)]
    cases += [[float(rng.choice([0, 0, 0, 1, 2, 5, 9, 9])) for _ in range(rng.randrange(1, 400))] for _ in range(20)]
    frame = sql.createDataFrame(list(enumerate(cases)), "i int, levels array<double>")
    got = frame.select("i", F.expr("peaks_of_levels(levels, 3, 30)").alias("p")).collect()
    assert {r.i: [(x.second, round(x.score, 6)) for x in r.p] for r in got} == {i: greedy(x, 3, 60) for i, x in enumerate(cases)}
    odd = sql.sql("SELECT peaks_of_levels(NULL, 3, 30) AS a, peaks_of_levels(array(), 3, 30) AS b, peaks_of_levels(array(1D, 2D, 9D), 0, 30) AS c, peaks_of_levels(array(NULL, NULL, 0D), 3, 30) AS d").first()
    assert odd.a is None and odd.b == [] and odd.c == [] and [tuple(x) for x in odd.d] == [(2, 70.0)]
