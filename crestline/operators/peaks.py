"""Greedy choice of well-separated peaks: one-dimensional non-maximum suppression.

Again and again the best remaining candidate of a series is taken, the earliest of
equals, and candidates from ``separation`` before it to just under ``separation``
after it go. A peak suppresses at most twice the separation of candidates, so the
k-th is among the best 2 (k - 1) separation + 1: no more of a series is gathered,
however long it is, and Spark drops the others before the shuffle where it can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.params import DetectParams

_PICKS = "CAST(array() AS array<struct<neg:double,second:bigint>>)"


def best_candidates(found: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """The candidates among which all peaks of their series are."""
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("score").desc(), "second"))
    return found.withColumn("_place", place).where(F.col("_place") <= p.most_candidates).drop("_place")


def select_peaks(found: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """(series_id, rank, second, score), best first, by one pass over each series' best candidates in order.

    A candidate is accepted unless an accepted one suppresses it, until there are k.
    """
    sep, found = p.separation, best_candidates(found, p)
    fold = f"""aggregate(array_sort(collect_list(struct(-score AS neg, CAST(second AS bigint) AS second))), {_PICKS},
        (a, c) -> if(size(a) >= {p.k} OR exists(a, x -> c.second >= x.second - {sep} AND c.second < x.second + {sep}), a, concat(a, array(c))))"""
    picked = found.groupBy("series_id").agg(F.expr(fold).alias("picks"))
    return picked.select("series_id", F.posexplode("picks").alias("i", "pick")).select("series_id", (F.col("i") + 1).alias("rank"), F.col("pick.second").alias("second"), (-F.col("pick.neg")).alias("score"))
