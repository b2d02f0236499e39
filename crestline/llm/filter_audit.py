"""How filters interact: what each removes, alone and in any order, from additive counts.

Five filters look at a text: A few words, B few distinct words, C many capitals, D
certain signs, E an equal text under a smaller identifier. Which of them a document
fails is a set of five bits, its mask. Whatever the order of the filters, a document is
removed by the first of its failing ones, so counts of masks for each part, with those
labelled good or toxic, hold all that the report needs: they are summed in every task,
and all 120 orders are read off them at the end.

E needs equal texts to meet. A counting Bloom filter clears most of them first: every
task counts its texts' hashed places, up to two; counts are merged by segments of fixed
width into bits of the places that were hit twice. A text with a place hit once is
certainly unique. Only the others, possible repeats, are shuffled by their full text
for its smallest identifier. The filter grows with the table up to a fixed size, as
tasks get it whole; beyond that more texts pass it and are shuffled, and the result is
the same.

Cases: a null text is empty, a null source the part ''; null identifiers are larger
than any other, none is smaller than another, and they have no labels; rows that
repeat an identifier and text fail E both or neither; of several labels of an
identifier one that says good, or toxic, is enough, and a null one says nothing; an
empty table gives no parts; other columns may have any names.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import drop_written, slices, text_or_empty, tidy, written

FILTERS = "ABCDE"
#: Places of the filter: for each text at least, at most, and of a segment. Places that a text hits.
_EACH, _MOST, _SEGMENT, _HASHES = 16, 1 << 28, 1 << 16, 3
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: bytes, points: int, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> int:
    """The bits of A to D that a UTF-8 text of so many code points fails."""
    words = text.split()  # of bytes: at ASCII white space
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = (len(words) < least_words, 100 * len(set(words)) < distinct_percent * len(words), 100 * capitals > capital_percent * points, _SIGNS.search(text) is not None)
    return sum(bit << i for i, bit in enumerate(failed))


def _places(texts: list[bytes], size: int) -> np.ndarray:
    """The places of each text, a row each."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in texts), np.uint64, len(texts))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(size - 1) for i in range(_HASHES)], axis=1).astype(np.int64)


def _once(places: np.ndarray) -> np.ndarray:
    """The places with those that one text hits several times left out, so that it counts once."""
    row = np.sort(places, axis=1)
    fresh = np.ones(row.shape, bool)
    fresh[:, 1:] = row[:, 1:] != row[:, :-1]
    return row[fresh]


def repeated_places(texts: DataFrame, size: int) -> np.ndarray:
    """One bit for each of ``size`` places: whether two rows of the binary column hit it."""

    def count(batches):
        for batch in slices(batches, 20_000):
            found, many = np.unique(_once(_places(batch.column(0).to_pylist(), size)), return_counts=True)
            segment, first = np.unique(found // _SEGMENT, return_index=True)
            at, twice = np.split((found % _SEGMENT).astype(np.uint16), first[1:]), np.split(many > 1, first[1:])
            yield pa.record_batch([pa.array(segment, pa.int32()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in twice], pa.binary())], ["segment", "at", "twice"])

    def packed(segment: int, counts: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(counts == 2, bitorder="little").tobytes()
        return pa.record_batch([pa.array([segment], pa.int32()), pa.array([bits], pa.binary())], ["segment", "bits"])

    def merge(batches):
        now, counts = None, None  # a segment's rows follow one another, over batches too
        for batch in batches:
            for segment, at, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    if now is not None:
                        yield packed(now, counts)
                    now, counts = segment, np.zeros(_SEGMENT, np.uint8)
                at = np.frombuffer(at, np.uint16)
                counts[at] = np.minimum(2, counts[at] + 1 + np.frombuffer(twice, bool))
        if now is not None:
            yield packed(now, counts)

    partial = texts.mapInArrow(tidy(count), "segment int, at binary, twice binary")
    sorted_ = partial.repartition(max(1, min(size // _SEGMENT, 1_000)), "segment").sortWithinPartitions("segment")
    found = sorted_.mapInArrow(tidy(merge), "segment int, bits binary").toArrow()
    filled = np.zeros((size // _SEGMENT, _SEGMENT // 8), np.uint8)
    for segment, bits in zip(found["segment"].to_pylist(), found["bits"].to_pylist(), strict=True):
        filled[segment] = np.frombuffer(bits, np.uint8)
    return filled.reshape(-1)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", most_places: int = _MOST, **limits) -> DataFrame:
    """doc_id, part and mask of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).cast("binary").alias("text"))
    size = max(_SEGMENT, min(most_places, 1 << (_EACH * rows.count()).bit_length()))
    twice = rows.sparkSession.sparkContext.broadcast(repeated_places(rows.select("text"), size))

    def run(batches):
        bits = twice.value
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            places = _places(texts, size)
            maybe = ((bits[places >> 3] >> (places & 7)) & 1).all(axis=1)
            failed = [failures(x, len(x.decode()), **limits) for x in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(failed, pa.int32()), pa.array(texts, pa.binary(), mask=~maybe)], ["doc_id", "part", "mask", "text"])

    seen = written(rows.mapInArrow(tidy(run), "doc_id long, part string, mask int, text binary"), "audited")
    # the keys of the two sides are expressions of their own, so that the join deals both out and can split a frequent text
    key = F.substring("text", 1, (1 << 31) - 1)
    maybe = seen.where("text IS NOT NULL")
    firsts = maybe.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").select(key.alias("key"), "first")
    met = maybe.withColumn("key", key).drop("text").join(firsts, "key", "left")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    repeated = met.select("doc_id", "part", F.when(later, F.col("mask").bitwiseOR(1 << 4)).otherwise(F.col("mask")).alias("mask"))
    return seen.where("text IS NULL").select("doc_id", "part", "mask").unionByName(repeated)


def mask_counts(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly these filters, and how many of them have the label."""
    of = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    both = marked.join(of.where("good + toxic > 0"), "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit, bits before) of each step of each order of the filters."""
    out = []
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            out.append((order, i + 1, bit, before))
            before |= bit
    return out


def report(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the counts of masks.

    Of the 120 orders a document's failing filters come first equally often, so it
    gives each of its m filters 120 / m of the Shapley count.
    """
    table = ", ".join(f"named_struct('o', '{o}', 's', {s}, 'b', {b}, 'p', {p})" for o, s, b, p in steps())
    at = counts.select("*", F.explode(F.expr(f"array({table})")).alias("x"))
    total = lambda when, value="n": F.sum(F.when(F.expr(when), F.expr(value)).otherwise(0)).cast("long")
    removed = "mask & x.b > 0 AND mask & x.p = 0"
    return at.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step")).agg(
        total("mask & (x.p | x.b) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("mask & x.b > 0 AND mask & x.p > 0").alias("redundant"),
        total("mask = x.b").alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total("mask & x.b > 0", "n * (120 DIV bit_count(mask))").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **limits) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``labels``: doc_id, quality, toxic. ``limits``: least_words, distinct_percent and
    capital_percent of the filters, and most_places of the Bloom filter.
    """
    counts = written(mask_counts(masks(docs, id_col, text_col, part_col, **limits), labels), "mask-counts")
    return report(counts)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), e AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY text), false) THEN 16 ELSE 0 END AS mask
  FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM e LEFT JOIN l ON l.doc_id = e.doc_id GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)
), p AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1 : step - 1]), 0)::INTEGER AS before FROM p, (SELECT unnest(range(1, 6)) AS step)
)
SELECT part, filter_order, step::INTEGER AS step,
       sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & b > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & b > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM m, s GROUP BY part, filter_order, step
"""
