"""The choice of peaks from SQL: a table function over scores, and a function of a plain array of levels.

    register(spark)
    SELECT * FROM pick_peaks(TABLE(scores), k => 6, duration => 45)
    SELECT peaks_of_levels(levels, 6, 45) FROM recordings

``scores`` is what ``series.scored`` gives for rows: series_id, second, score and n,
the series' length; other columns are left out. The table function itself asks for the
table to be partitioned by series_id and ordered by second. It takes rows one after
another and keeps the best of a series only: 2 (k - 1) separation + 1 of them decide
its peaks, so a partition is never held.
"""

from __future__ import annotations

import heapq

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf

from crestline.params import DetectParams

_COLUMNS = ("series_id", "second", "score", "n")


def _params(k, duration) -> DetectParams:
    return DetectParams(k=6 if k is None else k, duration=45 if duration is None else duration)


class PickPeaks:
    """(series_id, rank, second, score) of one series after another, best first.

    Rows with a null second, score or n are no candidates; a null series is one; a
    series without candidates, or a table without rows, gives none. k and duration
    must be constants in their ranges, or the query is refused when it is planned.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument | None = None, duration: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table: pick_peaks(TABLE(scores))")
        given = {f.name: f.dataType for f in rows.dataType.fields}
        if missing := [c for c in _COLUMNS if c not in given]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        for name, argument in (("k", k), ("duration", duration)):
            if argument is not None and (not argument.isConstantExpression or not isinstance(argument.value, int)):
                raise ValueError(f"{name} must be a constant whole number")
        _params(k and k.value, duration and duration.value)
        out = T.StructType([T.StructField("series_id", given["series_id"]), T.StructField("rank", T.IntegerType()), T.StructField("second", T.LongType()), T.StructField("score", T.DoubleType())])
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("series_id")], orderBy=[OrderingColumn("second")], select=[SelectedColumn(c) for c in _COLUMNS])

    def __init__(self):
        self.best: list[tuple[float, int]] = []  # a heap, the worst of the best on top
        self.series = self.p = None

    def eval(self, row, k=None, duration=None):
        self.p = self.p or _params(k, duration)
        self.series, second, score, n = row["series_id"], row["second"], row["score"], row["n"]
        if second is None or score is None or n is None or not score >= self.p.min_score:
            return
        margin = min(self.p.edge_cap, n // 10)
        if not margin <= second < n - margin:
            return
        if len(self.best) < self.p.most_candidates:
            heapq.heappush(self.best, (score, -second))
        else:
            heapq.heappushpop(self.best, (score, -second))

    def terminate(self):
        taken: list[int] = []
        for score, minus in sorted(self.best, reverse=True):
            second, reach = -minus, self.p.separation
            if len(taken) < self.p.k and not any(x - reach <= second < x + reach for x in taken):
                taken.append(second)
                yield self.series, len(taken), second, score


#: Peaks of an array of levels a second each: the upper median is the baseline, nulls count as the floor.
_OF_LEVELS = """
CREATE OR REPLACE TEMPORARY FUNCTION peaks_of_levels(levels ARRAY<DOUBLE>, k INT, duration INT)
RETURNS ARRAY<STRUCT<second: INT, score: DOUBLE>>
COMMENT 'The best k moments of a series of levels, best first, that lie duration and {gap} seconds apart'
RETURN transform(
  transform(array(transform(levels, x -> coalesce(x, CAST({floor} AS DOUBLE)))), dense ->
    transform(array(get(array_sort(dense), CAST(floor(size(dense) / 2) AS INT))), base ->
      aggregate(
        array_sort(filter(
          transform(dense, (x, i) -> struct(base - x AS below, i AS second)),
          c -> c.below <= -{least} AND c.second >= least({edge}, floor(size(dense) / 10)) AND c.second < size(dense) - least({edge}, floor(size(dense) / 10)))),
        CAST(array() AS ARRAY<STRUCT<below: DOUBLE, second: INT>>),
        (a, c) -> if(size(a) >= k OR exists(a, x -> c.second >= x.second - duration - {gap} AND c.second < x.second + duration + {gap}), a, array_append(a, c))))[0])[0],
  c -> struct(c.second AS second, -c.below AS score))
"""


def register(spark: SparkSession) -> None:
    """Make ``pick_peaks`` and ``peaks_of_levels`` known to the session's SQL.

    ``peaks_of_levels`` is built of SQL functions alone. Null levels count as the
    floor; a null array gives null, an empty one or k below 1 an empty array.
    """
    p = DetectParams()
    spark.udtf.register("pick_peaks", udtf(PickPeaks))
    spark.sql(_OF_LEVELS.format(gap=p.gap, floor=p.floor, least=p.min_score, edge=p.edge_cap))
