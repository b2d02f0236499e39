"""Peaks of any number in series of any length: suppression by local dominance, in rounds.

The greedy choice takes the best candidate of a series, drops those around it, and
begins again. Whether a candidate becomes a peak depends only on better ones near it:

- one that a better peak suppresses is no peak;
- one that no better candidate could suppress, as all of them around it are decided
  and none of them is a peak that does, is a peak, whatever happens elsewhere.

So stretches of a series are decided apart, each with copies of the candidates within
the separation on either side. A stretch goes through its candidates from the best on;
one is left undecided if a better undecided one could suppress it, and those of the
copies that no known peak suppresses are undecided, as their surroundings aren't seen.
The best undecided candidate of a series is decided in every round, so the rounds end;
what a round decides is final, so the result is that of the greedy choice.

A peak at x suppresses from x - separation to just under x + separation. The range is
open at one end, so of two candidates exactly the separation apart the earlier is
suppressed by the later if that is better, and not the other way round.

Rounds are needed where ever better candidates follow each other across stretches. The
stretches grow from round to round and every other round they are moved by half of
their length, so chains that a border cuts go in the next one. A series that rises
without a break from end to end takes a round for each of its longest stretches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.peaks import select_peaks
from crestline.params import DetectParams
from crestline.shared import drop_written, written

#: Up to so many peaks of a series one array per series holds its best candidates; beyond it the rounds do the work.
FEW = 200
#: The seconds of a stretch, in the first round and at most; a task holds the candidates of one.
STRETCH, LONGEST = 100_000, 1_000_000


def _decided(sep: int, size: int, shift: int):
    """A round's decision on one stretch: its rows that are peaks or still undecided."""

    def decide(key, rows):
        start = int(key[1]) * size - shift
        place = rows["second"].to_numpy() - start
        taken, left = rows["taken"].to_numpy(dtype=bool, copy=True), np.ones(len(rows), dtype=bool)
        inside = (place >= 0) & (place < size)
        gone, unsure = (np.zeros(size + 4 * sep, dtype=bool) for _ in range(2))
        for i in np.lexsort((place, -rows["score"].to_numpy())):
            at = place[i] + 2 * sep
            around = slice(at - sep, at + sep)
            if taken[i]:
                gone[around] = True
            elif gone[at]:
                left[i] = False
            elif unsure[at] or not inside[i]:
                unsure[around] = True
            else:
                taken[i] = gone[around] = True
        kept = inside & left
        return rows.assign(taken=taken).loc[kept, ["series_id", "second", "score", "taken"]]

    return decide


def decided(rows: DataFrame, sep: int, size: int, shift: int) -> DataFrame:
    """One round over (series_id, second, score, taken): what is suppressed goes, and of the rest new peaks are taken."""
    size = max(size, 2 * sep + 1)  # so that a candidate is seen by three stretches at most
    near = F.array_distinct(F.array(*(F.floor((F.col("second") + (d + shift)) / size) for d in (-sep, 0, sep))))
    cut = rows.select("series_id", "second", "score", "taken", F.explode(near).alias("part"))
    return cut.groupBy("series_id", "part").applyInPandas(_decided(sep, size, shift), rows.schema)


def all_peaks(found: DataFrame, p: DetectParams = DetectParams(), stretch: int = STRETCH) -> DataFrame:
    """(series_id, second, score): every candidate that is a peak, whatever k is.

    ``found``: (series_id, second, score) of candidates, as ``candidates`` gives them.
    Rows that repeat a second count once; a null series is one; rows without a second
    or a score are no candidates. Rounds are written to the shared folder, so a lost
    executor costs the tasks it ran; the driver learns only whether any is undecided.
    """
    rows = found.select("series_id", F.col("second").cast("bigint").alias("second"), F.col("score").cast("double").alias("score"), F.lit(False).alias("taken"))
    rows = rows.where("second IS NOT NULL AND score IS NOT NULL")
    before, number, size = None, 0, stretch
    while True:
        rows = written(decided(rows, p.separation, size, size // 2 * (number % 2)), "peaks")
        if before is not None:
            drop_written(before)
        if rows.where("NOT taken").isEmpty():
            return rows.drop("taken")
        before, number, size = rows, number + 1, max(stretch, min(2 * size, LONGEST))


def many_peaks(found: DataFrame, p: DetectParams = DetectParams(), stretch: int = STRETCH) -> DataFrame:
    """(series_id, rank, second, score), the best k peaks of each series, best first: what ``select_peaks`` gives, for any k."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("score").desc(), "second"))
    return all_peaks(found, p, stretch).select("series_id", rank.alias("rank"), "second", "score").where(F.col("rank") <= p.k)


def chosen_peaks(found: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """The peaks in one plan if k is small, else in rounds; the rows are the same."""
    return select_peaks(found, p) if p.k <= FEW else many_peaks(found, p)
