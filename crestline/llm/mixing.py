"""Mixing sources to target weights by Pareto order sampling.

A document of a source shall be taken e times on average, where e is in proportion
to the document's weight, stops at ``cap``, and is such that the source's words
come to its target. The weight is the number of binary digits of the document's
size, so of the words that a source may give, long documents give the more. The
whole part of e is taken for certain; the fraction is the document's inclusion
probability p for one copy more. Documents are ranked by random odds divided by
inclusion odds (Rosen's Pareto sampling), u/(1-u) over p/(1-p) with u a hash of
the identifier, or of the text where that is null, and taken in that order as long as they fit into the words the
source still needs: a sample of fixed size, in words, with unequal probabilities.
The document whose size comes nearest to what is then missing closes the gap, if
that brings the source nearer to its target.

The cut in the order is found by histogram refinement: partial counts over the
bins of each source, then over finer bins of the one bin that holds the cut, so
no source is ever sorted in one task or gathered anywhere. What decides on a
document is then a few numbers for its source and weight, and a row is repeated or
left out where it lies. One row for each source passes through one task where
targets are shared out, which is meant for up to some millions of sources.

Cases: a null text has size 0; documents of size 0 are not taken; a null source
is a source, last in order; rows without an identifier are told apart by their
texts; rows that repeat an identifier, or a text without one, source and size tie
in the order and stand or fall together; an empty table gives an empty result, and targets are 0 when all sizes are; other
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import drop_written, text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the uniform hash and bits settled by each refinement.
BITS, STEP = 48, 12


def size_of(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def hash_of(id_col: str, text_col: str, seed: int) -> Column:
    """The identifier's hash of 48 bits; that of the text's MD5 if it is null."""
    salt = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.md5(text_or_empty(text_col))))
    return F.conv(F.substring(F.md5(salt), 1, BITS // 4), 16, 10).cast("long")


def weight_of(size: Column) -> Column:
    """The binary digits of a size; 0 for none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, size in words, u48 and weight of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), hash_of(id_col, text_col, seed).alias("u48"))
    return rows.withColumn("weight", weight_of(F.col("size")))


def water_filled(sources: DataFrame, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Each source's target: its weight's share of all words, stopped at ``cap`` times its size.

    The excess is shared again by weight. Sources in the order of cap over weight
    fill up one after another; with the first k full, the rest share what is left
    at one rate, and the right k is the smallest whose rate fits under the next
    source's cap. One row per source, so the windows are small.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ws = sources.withColumn("weight", weight)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ws = ws.withColumn("most", F.col("source_size") * F.lit(cap))
    ws = ws.select("*", F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weight"))
    everything = Window.partitionBy()
    ws = ws.select("*", ((F.sum("source_size").over(everything) - F.col("full")) / (F.sum("weight").over(everything) - F.col("full_weight"))).alias("rate"))
    fits = F.when(F.col("rate") * F.col("weight") <= F.col("most"), F.col("rate"))
    ws = ws.select("*", F.max(F.struct(fits.isNotNull().alias("ok"), (-F.col("full_weight")).alias("first"), F.col("rate").alias("rate"))).over(everything).alias("at"))
    return ws.select("source", "source_size", F.when(F.col("full_weight") < -F.col("at.first"), F.col("most")).otherwise(F.col("at.rate") * F.col("weight")).alias("target"))


def pareto_key(u48: Column, p: Column) -> Column:
    """Random odds over inclusion odds, q, as the whole number floor(2^48 q / (1 + q)): the same order."""
    u = (u48 + F.lit(0.5)) / F.lit(float(1 << BITS))
    q = F.try_divide(u / (1 - u), p / (1 - p))  # null where p is 0, and evaluated there too
    return F.floor(q / (1 + q) * F.lit(float(1 << BITS))).cast("long")


def _few(table: DataFrame, most: int = 10_000) -> DataFrame:
    """The table, marked for broadcast if it is found to have at most ``most`` rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def expected_copies(rows: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """source, weight, source_size, target, whole, p, and extra: the source's words beyond the whole copies.

    Of a source's weights the largest reach ``cap`` first; with those full, the
    rest share what is left in proportion, and the right number of full ones is the
    smallest for which no other exceeds the cap. A source has at most 63 weights.
    """
    sizes = rows.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words"))
    t = targets.withColumnRenamed("source", "of")
    sizes = sizes.join(_few(t), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    by_source = Window.partitionBy("source")
    larger = by_source.orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    product = F.col("words") * F.col("weight")
    ws = sizes.select("*", F.coalesce(F.sum("words").over(larger), F.lit(0)).alias("full"), (F.sum(product).over(by_source) - F.coalesce(F.sum(product).over(larger), F.lit(0))).alias("rest"))
    ws = ws.withColumn("rate", (F.col("target") - F.lit(float(cap)) * F.col("full")) / F.col("rest"))
    fits = F.when(F.col("rate") * F.col("weight") <= cap, F.struct("weight", "rate"))
    ws = ws.withColumn("at", F.max(fits).over(by_source))
    copies = F.when(F.col("at").isNull() | (F.col("weight") > F.col("at.weight")), F.lit(float(cap))).otherwise(F.least(F.col("at.rate") * F.col("weight"), F.lit(float(cap))))
    ws = ws.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.col("whole"))
    extra = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(by_source)
    return ws.select("source", "weight", "source_size", "target", "whole", "p", extra.alias("extra"))


def _of_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with source, weight and u48 joined to their line of the plan, with their key; null where p is 0."""
    line = plan.withColumnsRenamed({"source": "of", "weight": "of_weight"})
    found = rows.join(_few(line), F.col("source").eqNullSafe(F.col("of")) & (F.col("weight") == F.col("of_weight")))
    return found.withColumn("key", F.when(F.col("p") > 0, pareto_key(F.col("u48"), F.col("p"))))


def _cut(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """of, bound, closing: the keys below ``bound`` are taken and so is ``closing``, which may be null.

    ``rows``: source, weight, u48, size; ``plan`` as from expected_copies.
    """
    open_plan = plan.where("extra > 0").select("source", "weight", "p", "extra")
    state = open_plan.select(F.col("source").alias("cut_of")).distinct().select("cut_of", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("filled"))
    keyed = _of_plan(rows, open_plan).where("key IS NOT NULL").select("of", "key", "size", "extra")
    for shift in range(BITS - STEP, -1, -STEP):
        held = keyed.join(_few(state.select("cut_of", "bin", "filled")), F.col("of").eqNullSafe(F.col("cut_of"))).where(F.shiftright("key", shift + STEP) == F.col("bin"))
        fine = held.groupBy("of", F.shiftright("key", shift).alias("fine")).agg(F.sum("size").alias("words"), F.min("extra").alias("extra"), F.min("filled").alias("filled"))
        running = Window.partitionBy("of").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
        fine = fine.withColumn("before", F.col("filled") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        last = fine.where("before <= extra").groupBy("of").agg(F.max_by(F.struct(F.col("fine").alias("bin"), F.col("before").alias("filled"), "words", "extra"), "fine").alias("s"))
        state = written(last.select(F.col("of").alias("cut_of"), "s.*"), "mix-cut")
    fits = F.col("filled") + F.col("words") <= F.col("extra")
    state = state.select("cut_of", F.when(fits, F.col("bin") + 1).otherwise(F.col("bin")).alias("bound"), (F.col("extra") - F.when(fits, F.col("filled") + F.col("words")).otherwise(F.col("filled"))).alias("gap"))
    left = keyed.join(_few(state), F.col("of").eqNullSafe(F.col("cut_of"))).where("key >= bound")
    groups = left.groupBy("of", "key").agg(F.sum("size").alias("words"), F.min("gap").alias("gap"))
    best = groups.where("abs(words - gap) < gap").groupBy("of").agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")), "key")).alias("best"))
    best = best.select(F.col("of").alias("best_of"), F.col("best.key").alias("closing"))
    return state.join(_few(best), F.col("cut_of").eqNullSafe(F.col("best_of")), "left").select("cut_of", "bound", "closing")


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(the sizes of all rows, the plan of the mix by source and weight), both written."""
    rows = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    targets = written(water_filled(rows.groupBy("source").agg(F.sum("size").alias("source_size")), float(cap), weights), "mix-targets")
    plan = written(expected_copies(rows, targets, cap), "mix-plan")
    cut = _cut(rows, plan)
    plan = plan.join(_few(cut), F.col("source").eqNullSafe(F.col("cut_of")), "left").drop("cut_of", "extra")
    empty = targets.select("source", F.lit(0).cast("long").alias("weight"), "source_size", "target", F.lit(0).cast("long").alias("whole"), F.lit(0.0).alias("p"), F.lit(None).cast("long").alias("bound"), F.lit(None).cast("long").alias("closing"))
    return rows, written(plan.unionByName(empty), "mix-lines")


def _copies() -> Column:
    more = (F.col("key") < F.col("bound")) | F.coalesce(F.col("key") == F.col("closing"), F.lit(False))
    return (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rows, plan = planned(docs, id_col, text_col, source_col, weights, cap, seed)
    mixed = _of_plan(rows, plan).withColumn("copies", _copies())
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, with their columns, each as many times as the mix takes it.

    A row's copies follow from its own identifier, source and size and the plan's
    line for them, so texts are not shuffled unless there are very many sources.
    """
    sizes, plan = planned(docs, id_col, text_col, source_col, weights, cap, seed)
    drop_written(sizes)
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(row, F.col(source_col).alias("source"), size_of(text_col).alias("size"), hash_of(id_col, text_col, seed).alias("u48")).withColumn("weight", weight_of(F.col("size")))
    taken = _of_plan(rows, plan).withColumn("copies", _copies()).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT AS u48
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 3.0::DOUBLE AS most,
         coalesce(sum(source_size * 3.0::DOUBLE) OVER b, 0) AS full_words, coalesce(sum(weight) OVER b, 0) AS full_weight
  FROM s WINDOW b AS (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT *, (sum(source_size) OVER () - full_words)::DOUBLE / (sum(weight) OVER () - full_weight)::DOUBLE AS rate FROM f
), k AS (
  SELECT min(full_weight) AS at, arg_min(rate, full_weight) AS rate FROM r WHERE rate * weight <= most
), t AS (
  SELECT source, source_size, CASE WHEN full_weight < k.at THEN most ELSE k.rate * weight END AS target FROM r, k
), cs AS (
  SELECT d.source, length(bin(size)) AS w, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY 1, 2
), ws AS (
  SELECT cs.*, t.target, coalesce(sum(words) OVER b, 0)::DOUBLE AS full_words,
         (sum(words * w) OVER (PARTITION BY cs.source) - coalesce(sum(words * w) OVER b, 0))::DOUBLE AS rest
  FROM cs JOIN t ON cs.source IS NOT DISTINCT FROM t.source
  WINDOW b AS (PARTITION BY cs.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rs AS (
  SELECT *, (target - 3.0::DOUBLE * full_words) / rest AS rate FROM ws
), tops AS (
  SELECT source, max(w) AS top, arg_max(rate, w) AS rate FROM rs WHERE rate * w <= 3 GROUP BY source
), es AS (
  SELECT rs.source, w, words, target, CASE WHEN tops.top IS NULL OR w > tops.top THEN 3.0::DOUBLE ELSE least(tops.rate * w, 3.0::DOUBLE) END AS e
  FROM rs LEFT JOIN tops ON rs.source IS NOT DISTINCT FROM tops.source
), p AS (
  SELECT source, w, floor(e)::BIGINT AS whole, e - floor(e) AS p, target - sum(floor(e)::BIGINT * words) OVER (PARTITION BY source)::DOUBLE AS extra FROM es
), q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(p.whole, 0) AS whole, p.p, p.extra, (u48 + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.size > 0 AND length(bin(d.size)) = p.w
), o AS (
  SELECT *, CASE WHEN p > 0 AND extra > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q
), e AS (
  SELECT *, floor(odds / (1 + odds) * 281474976710656.0::DOUBLE)::BIGINT AS key FROM o
), w AS (
  SELECT *, sum(size) OVER (PARTITION BY source, key) AS words, CASE WHEN key IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY key NULLS LAST RANGE UNBOUNDED PRECEDING) END AS upto FROM e
), c AS (
  SELECT *, coalesce(upto <= extra, false) AS fits, extra - coalesce(max(CASE WHEN upto <= extra THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM w
), z AS (
  SELECT source, arg_min(key, {'a': abs(words - gap), 'b': key}) AS closing FROM c WHERE key IS NOT NULL AND NOT fits AND abs(words - gap) < gap GROUP BY source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN fits OR key = closing THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN fits OR key = closing THEN 1 ELSE 0 END)::INTEGER AS copies
FROM c LEFT JOIN z ON c.source IS NOT DISTINCT FROM z.source
"""
