"""From samples to a scored series, for any number of series at once.

Every function takes and returns DataFrames keyed by series_id; ``second`` is the
bucket's number from the start of its series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.params import DetectParams


#: Rows of the spine that are made from one row, so that no array is as long as a series.
_RUN = 65_536


def seconds_of(t: Column, p: DetectParams = DetectParams()) -> Column:
    """The bucket of a time; null for times before 0 and those that are no finite number."""
    at = t / F.lit(float(p.bucket_seconds))
    return F.when((at >= 0) & (at < float(1 << 62)), F.floor(at).cast("bigint"))


def bucket_max(samples: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """(series_id, second, level): the loudest level of each bucket, never below the floor.

    A maximum, so it is taken in each task before the shuffle and any order of
    samples gives the same. NaN levels should be cleaned before, as sources do.
    Times before 0 or that are no finite number are left out.
    """
    timed = samples.select("series_id", seconds_of(F.col("t"), p).alias("second"), "level").where("second IS NOT NULL")
    return timed.groupBy("series_id", "second").agg(F.greatest(F.max("level"), F.lit(p.floor)).alias("level"))


def observed(buckets: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """(series_id, observed, n, status): buckets seen, the series' length, and whether it is too_short or ok."""
    counts = buckets.groupBy("series_id").agg(F.count(F.lit(1)).alias("observed"), (F.max("second") + 1).cast("long").alias("n"))
    return counts.withColumn("status", F.when(F.col("observed") < p.min_buckets, "too_short").otherwise("ok"))


def densify(buckets: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """(series_id, second, level) for every second from 0 to the last one seen, gaps at the floor.

    The explicit form, a row for each second; the detection works on ``smooth_runs``.
    """
    last = buckets.groupBy("series_id").agg(F.max("second").cast("bigint").alias("last"))
    starts = last.select("series_id", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), "last", F.lit(_RUN).cast("bigint"))).alias("start"))
    spine = starts.select("series_id", F.explode(F.sequence("start", F.least(F.col("start") + _RUN - 1, "last"))).alias("second"))
    return spine.join(buckets, ["series_id", "second"], "left").select("series_id", "second", F.coalesce("level", F.lit(p.floor)).alias("level"))


def _exact(level: Column, p: DetectParams) -> Column:
    return F.round(level * 10**p.decimals).cast("bigint")


def smooth(dense: DataFrame, p: DetectParams = DetectParams(), stretch: int = 100_000) -> DataFrame:
    """(series_id, second, smoothed): the mean over ``half_window`` rows on either side, fewer at the ends.

    A long series is cut into stretches of ``stretch`` rows, each with copies of its
    neighbours' nearest rows, so that no task has to hold a series as a whole.
    """
    h = p.half_window
    stretch = max(stretch, h, 1)  # so that a row has neighbours in three stretches at most
    near = F.array_distinct(F.array(*(F.floor((F.col("second") + d) / stretch) for d in (-h, 0, h))))
    cut = dense.withColumn("part", F.explode(near)).where("part >= 0")
    w = Window.partitionBy("series_id", "part").orderBy("second").rowsBetween(-h, h)
    if p.decimals is None:
        mean = F.round(F.avg("level").over(w), 9)
    else:
        mean = F.sum(_exact(F.col("level"), p)).over(w).cast("double") / (F.count(F.lit(1)).over(w) * 10**p.decimals).cast("double")
    out = cut.select("series_id", "second", "part", mean.alias("smoothed"))
    return out.where(F.floor(F.col("second") / stretch) == F.col("part")).select("series_id", "second", "smoothed")


def smooth_runs(buckets: DataFrame, p: DetectParams = DetectParams(), stretch: int = 100_000) -> DataFrame:
    """(series_id, first, last, smoothed, n): the smoothed dense series by runs, without making it dense.

    Only seconds within ``half_window`` of an observed bucket can differ from the floor:
    each of them is a run of its own, and what lies between is one run at the floor,
    however long. So work and rows follow the buckets, not the time they span.

    ``buckets``: series_id, second, level, and n, the series' length. Stretches of
    ``stretch`` seconds are worked on apart, with copies of their neighbours' nearest
    buckets, and know the last bucket before them.
    """
    h = p.half_window
    stretch = max(stretch, 2 * h, 1)
    part = lambda x: F.floor(x / F.lit(stretch)).cast("bigint")
    second = F.col("second")
    near = F.array_distinct(F.array(*(part(second + d) for d in (-2 * h, 0, 2 * h))))
    cut = buckets.select("series_id", "second", "level", "n", F.explode(near).alias("part")).where("part >= 0")
    ends = buckets.groupBy("series_id", part(second).alias("part")).agg(F.max("second").alias("high"))
    lower = ends.select("series_id", "part", F.lag("high").over(Window.partitionBy("series_id").orderBy("part")).alias("lower"))
    cut = cut.join(lower, ["series_id", "part"], "left")
    order = Window.partitionBy("series_id", "part").orderBy("second")
    cut = cut.select("*", F.lag("second").over(order).alias("before"), F.lead("second").over(order).alias("after"))
    # of the seconds beside a bucket, those up to h after one belong to it, and those before the next one only beyond that
    begin = F.greatest(second - h, F.coalesce(F.col("before") + h + 1, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    end = F.least(second + h, F.coalesce(F.col("after") - 1, F.col("n") - 1), F.col("n") - 1)
    run = lambda first, last: F.struct(first.alias("at"), last.alias("last"))
    places = F.transform(F.sequence(F.least(begin, second), F.greatest(end, second)), lambda x: run(x, x))
    free = F.coalesce(F.coalesce("before", "lower") + h + 1, F.lit(0).cast("bigint"))
    gap = (free < second - h) & (part(second) == F.col("part"))
    rows = cut.select("series_id", "part", "n", "second", "level", F.inline(F.when(gap, F.array_append(places, run(free, second - h - 1))).otherwise(places)))
    level = F.when((F.col("at") == second) & (F.col("last") == second), F.col("level"))
    around = Window.partitionBy("series_id", "part").orderBy("at").rangeBetween(-h, h)
    exact = level if p.decimals is None else _exact(level, p)
    rows = rows.select("series_id", "part", "n", "second", "at", "last", F.coalesce(F.sum(exact).over(around), F.lit(0)).alias("sum"), F.count(exact).over(around).alias("seen"))
    width = F.least(F.col("at") + h, F.col("n") - 1) - F.greatest(F.col("at") - h, F.lit(0)) + 1
    if p.decimals is None:
        mean = F.round((F.col("sum") + (width - F.col("seen")) * F.lit(p.floor)) / width, 9)
        floor = F.round(F.lit(p.floor).cast("double"), 9)
    else:
        low = round(p.floor * 10**p.decimals)
        mean = (F.col("sum") + (width - F.col("seen")) * F.lit(low)).cast("double") / (width * 10**p.decimals).cast("double")
        floor = F.lit(low).cast("double") / F.lit(10**p.decimals).cast("double")
    # a gap goes with the stretch of the bucket after it, a second beside a bucket with its own
    beside = rows.where(part(F.when(F.col("seen") > 0, F.col("at")).otherwise(second)) == F.col("part"))
    return beside.select("series_id", F.col("at").alias("first"), "last", F.when(F.col("seen") > 0, mean).otherwise(floor).alias("smoothed"), "n")


def baseline(smoothed: DataFrame, bins: int = 200) -> DataFrame:
    """(series_id, baseline, n): the upper median, element n div 2 of the sorted series, and its length.

    ``smoothed``: rows of a second each, or runs with first and last, which count for
    their length. Equal values are counted before the shuffle. A sketch of a series'
    distinct values then cuts them into ``bins`` of about as many; the bins' counts
    tell in which one the median lies, and only its values are sorted and run through.
    The cuts only decide how evenly values are spread, so the result is exact whatever
    the sketch's error, and no task has to sort more than a bin of a series.
    """
    many = F.sum(F.col("last") - F.col("first") + 1) if "first" in smoothed.columns else F.count(F.lit(1))
    counted = smoothed.groupBy("series_id", "smoothed").agg(many.alias("many"))
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    sketch = F.kll_sketch_agg_double("smoothed", 4 * bins)
    cuts = counted.groupBy("series_id").agg(F.sum("many").alias("n"), F.array_distinct(F.kll_sketch_get_quantile_double(sketch, shares)).alias("cuts"))
    # cuts ascend, so the bin of a value is found by halving
    low, high = F.lit(0), F.size("cuts")
    steps = max(1, bins.bit_length())
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.alias("low"), high.alias("high")), lambda x, _: _halved(x), lambda x: x["low"])
    binned = counted.join(cuts, "series_id").select("series_id", "smoothed", "many", "n", found.alias("bin"))
    order = Window.partitionBy("series_id").orderBy("bin")
    sums = binned.groupBy("series_id", "bin", "n").agg(F.sum("many").alias("held")).withColumn("upto", F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.floor(F.col("n") / 2)
    target = sums.where((F.col("upto") > at) & (F.col("upto") - F.col("held") <= at)).select("series_id", "bin", (F.col("upto") - F.col("held")).alias("below"))
    left = binned.join(target, ["series_id", "bin"])
    upto = F.col("below") + F.sum("many").over(Window.partitionBy("series_id").orderBy("smoothed").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = left.select("series_id", "smoothed", "many", "n", upto.alias("upto"))
    return last.where((F.col("upto") > at) & (F.col("upto") - F.col("many") <= at)).select("series_id", F.col("smoothed").alias("baseline"), "n")


def _halved(x: Column) -> Column:
    """A step of the search for the number of cuts that are at most ``smoothed``."""
    middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
    go_up = (x["low"] < x["high"]) & (F.try_element_at("cuts", middle + 1) <= F.col("smoothed"))
    stay = x["low"] >= x["high"]
    return F.struct(F.when(go_up, middle + 1).otherwise(x["low"]).alias("low"), F.when(stay | go_up, x["high"]).otherwise(middle).alias("high"))


def scored(smoothed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(series_id, second, score, n) of rows, or (series_id, first, last, score, n) of runs: how far each lies above its series' baseline."""
    base = baseline(smoothed) if base is None else base
    places = [c for c in smoothed.columns if c in ("second", "first", "last")]
    rows = smoothed.select("series_id", *places, "smoothed")
    return rows.join(base, "series_id").select("series_id", *places, (F.col("smoothed") - F.col("baseline")).alias("score"), "n")


def candidates(scores: DataFrame, p: DetectParams = DetectParams()) -> DataFrame:
    """(series_id, second, score) of what may become peaks: high enough, and not at the edges.

    Of a run all seconds score alike, and the earliest come first, so no more of it can
    matter than the candidates that decide a series' peaks.
    """
    margin = F.least(F.lit(p.edge_cap).cast("long"), F.floor(F.col("n") / 10))
    low, high = margin, F.col("n") - 1 - margin
    enough = scores.where(F.col("score") >= p.min_score)
    if "first" not in scores.columns:
        return enough.where((F.col("second") >= low) & (F.col("second") <= high)).select("series_id", "second", "score")
    first = F.greatest("first", low)
    last = F.least(F.col("last"), high, first + p.most_candidates - 1)
    within = enough.select("series_id", "score", first.alias("first"), last.alias("last")).where("first <= last")
    if p.most_candidates > _RUN:  # in pieces, so that no array is as long as a run
        pieces = F.explode(F.sequence("first", "last", F.lit(_RUN).cast("bigint")))
        within = within.select("series_id", "score", "last", pieces.alias("first")).withColumn("last", F.least(F.col("first") + _RUN - 1, "last"))
    return within.select("series_id", F.explode(F.sequence("first", "last")).alias("second"), "score")
