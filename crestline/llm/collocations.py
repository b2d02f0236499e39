"""Collocations by top-order marginalisation: one count of longest windows, shorter phrases by ROLLUP.

A word's window is the word and its next four in its piece, padded where the piece
ends. Only windows are counted; every shorter phrase is the prefix of the windows at
its occurrences, so Spark's ROLLUP over the window's columns, which sums successively
shorter prefixes, gives the counts of all phrases without n-gram explosions of their own.

Most windows of natural text are unlike any other, and counting them all would move
several times the text. But a phrase that occurs ``least`` times consists of words
pairs and triples that do. So words are counted first, then pairs of frequent words, then
triples of frequent pairs, and a window ends where its first rare one does: this shortens
no occurrence of a phrase that may be a candidate, or of a part of one. Pairs and triples
are counted by hash in buckets, whose number follows the words': what a task counts
travels as gaps between buckets, and segments of fixed width are summed. What is frequent goes to the tasks as bits of
bounded number, which take some rare ones for frequent and never the other way; the
exact counts then drop what came along, so sizes of filters never show in a result.

Words are split from the bytes of many texts at once; texts are read four times, and
only counts are shuffled, summed in each task first. Numbers are exact: products are
decimals of 38 digits, good for counts of up to 10^15.

Cases: a null text is empty, a null language ``und``; a piece ends with its text;
texts of one word give no phrase but count in n; repeated rows count as often as they
are there; of equal scores and counts the phrase that is first in UTF-8 bytes ranks
first; an empty table gives an empty result; other columns may have any names, since
only the text and the language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import drop_written, slices, text_or_empty, tidy, written

#: What ends a piece, and what lies between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Words of a window.
LONGEST = 5
#: Bits of a filter: at most, and at least for each word. Hashes for each word.
_MOST_BITS, _BITS_EACH, _HASHES = 1 << 27, 16, 4
#: Buckets of a segment, and pairs that a task holds before it passes their counts on.
_SEGMENT, _HELD = 1 << 20, 4_000_000

_SPACE = pa.scalar(" ", pa.large_string())
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: break
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


class Words(NamedTuple):
    """The words of some texts: of each its key, piece and text; of each key its language, word and count."""

    key: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    lang: pa.Array
    word: pa.Array
    many: np.ndarray


def words_of(texts: pa.Array, langs: pa.Array) -> Words:
    """Lower-cased words of the texts; keys number what is distinct in language and word."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = _LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data else np.zeros(0, np.uint8)
    heads = bounds[:-1] - bounds[0]
    kind = _KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at_head = heads[heads < len(raw)]
    first[at_head] = inside[at_head]  # a text begins a word of its own
    start = np.flatnonzero(first)
    text = np.searchsorted(heads, start, "right") - 1
    piece = np.cumsum(kind == 2)[start] + text  # neither ever falls, so pieces differ
    offsets = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    words, tongues = found.dictionary_encode(), langs.dictionary_encode()
    tongue = tongues.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    size = max(1, len(words.dictionary))
    known, key, many = np.unique(tongue * size + words.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    return Words(key, piece, text, tongues.dictionary.take(pa.array(known // size)), words.dictionary.take(pa.array(known % size)), many)


def _batches(batches, most: int = 2_000) -> Iterator[Words]:
    for batch in slices(batches, most):
        yield words_of(batch.column(0), batch.column(1))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def _counts(rows: DataFrame, run, keys: list[str]) -> DataFrame:
    """Counts of string keys, summed over what every task gives."""
    schema = ", ".join([*(f"{k} string" for k in keys), "n long"])
    return rows.mapInArrow(tidy(run), schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def _row(n: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([*(x.cast(pa.string()) for x in columns.values()), pa.array(n.astype(np.int64))], [*columns, "n"])


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, phrase (one word) and n of all words."""

    def run(batches):
        for w in _batches(batches):
            yield _row(w.many, lang=w.lang, phrase=w.word)

    return _counts(rows, run, ["lang", "phrase"])


# --- filters of what is frequent ---


def _hash(word: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", "lang", word))


def _hashes(w: Words) -> np.ndarray:
    joined = pc.binary_join_element_wise(w.lang.cast(pa.large_string()), w.word, _SPACE).cast(pa.large_binary())
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in joined.to_pylist()), np.uint64, len(joined))


def _joined(*hashes: np.ndarray) -> np.ndarray:
    """The hash of words in a row, from theirs."""
    out = hashes[0]
    for i, h in enumerate(hashes[1:], 1):
        out = out ^ (h << np.uint64(23 * i) | h >> np.uint64(64 - 23 * i))
    return out


def bits_of(places: DataFrame, size: int) -> np.ndarray:
    """``size`` bits in 64-bit words, of which those in the column ``at`` are set."""
    blocks = places.groupBy(F.shiftright("at", 6).alias("block"))
    found = blocks.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["block"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``h``: some bits for each key, and no more than a fixed number."""
    size = min(_MOST_BITS, max(1 << 12, 1 << (_BITS_EACH * keys.count()).bit_length()))
    low, high = F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("long"))
    places = F.array(*((low + i * high).bitwiseAND(size - 1) for i in range(_HASHES)))
    return bits_of(keys.select(F.explode(places).alias("at")), size)


def _held(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be a key of the filter."""
    low, high, ok = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1), np.ones(len(h), bool)
    for i in range(_HASHES):
        ok &= _set(filter_, (low + np.uint64(i) * high) & np.uint64(len(filter_) * 64 - 1))
    return ok


# --- pairs and windows ---


def _pairs_at(w: Words, h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Where a frequent word has a frequent one after it in its piece."""
    ok = _held(frequent, h)[w.key]
    return np.flatnonzero(ok[:-1] & ok[1:] & (w.piece[:-1] == w.piece[1:]))


def _pair_hashes(w: Words, frequent: np.ndarray) -> np.ndarray:
    h = _hashes(w)
    at = _pairs_at(w, h, frequent)
    return _joined(h[w.key[at]], h[w.key[at + 1]])


def _linked(w: Words, frequent: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where frequent pairs begin, which of them have another that begins at their second word, and the hashes of those triples."""
    h = _hashes(w)
    at = _pairs_at(w, h, frequent)
    at = at[_in(pairs, _joined(h[w.key[at]], h[w.key[at + 1]]))]
    on = np.append(at[1:] == at[:-1] + 1, False)[: len(at)]
    first = at[on]
    return at, on, _joined(h[w.key[first]], h[w.key[first + 1]], h[w.key[np.minimum(first + 2, len(w.key) - 1)]])


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bucket of each hash is set."""
    return _set(bits, h & np.uint64(len(bits) * 64 - 1))


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes together and so on, which leaves little after compression."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]


def frequent_buckets(rows: DataFrame, hashes, words: int, least: int) -> np.ndarray:
    """Bits of the buckets in which what ``hashes`` finds in some Words comes to at least ``least``; ``words``: of all texts."""
    buckets = max(_SEGMENT, 1 << (words // 4).bit_length())

    def counted(held: list[np.ndarray]):
        found, many = np.unique(np.concatenate(held), return_counts=True)
        segment, first = np.unique(found // _SEGMENT, return_index=True)
        gaps = [_planes(np.diff(x, prepend=0)) for x in np.split(found % _SEGMENT, first[1:])]
        return pa.record_batch([pa.array(segment, pa.int64()), pa.array(gaps, pa.binary()), pa.array([_planes(x) for x in np.split(many, first[1:])], pa.binary())], ["segment", "gaps", "many"])

    def count(batches):
        held: list[np.ndarray] = []
        for w in _batches(batches):
            held.append((hashes(w) & np.uint64(buckets - 1)).astype(np.int64))
            if sum(map(len, held)) >= _HELD:
                yield counted(held)
                held = []
        if sum(map(len, held)):
            yield counted(held)

    def often(segment: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(segment * _SEGMENT + np.flatnonzero(counts >= least))], ["bucket"])

    def merge(batches):
        now, counts = None, None  # a segment's rows follow one another, over batches too
        for batch in batches:
            for segment, gaps, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    if now is not None:
                        yield often(now, counts)
                    now, counts = segment, np.zeros(_SEGMENT, np.int64)
                counts[np.cumsum(_unplaned(gaps), dtype=np.int64)] += _unplaned(many)
        if now is not None:
            yield often(now, counts)

    partial = rows.mapInArrow(tidy(count), "segment long, gaps binary, many binary")
    dealt = partial.repartition(max(1, min(buckets // _SEGMENT, 10_000)), "segment").sortWithinPartitions("segment")
    size = min(_MOST_BITS, buckets)
    return bits_of(dealt.mapInArrow(tidy(merge), "bucket long").select(F.col("bucket").bitwiseAND(size - 1).alias("at")), size)


def runs(rows: DataFrame, frequent, pairs, triples) -> DataFrame:
    """lang and words of each text: runs of words in which all pairs and triples are frequent, a null after each.

    Where a triple is rare, a run ends with its second word and the next begins with it,
    so every frequent pair is in one run.
    """

    def run(batches):
        for batch in slices(batches, 2_000):
            w = words_of(batch.column(0), batch.column(1))
            at, on, h = _linked(w, frequent.value, pairs.value)
            ends = ~on
            ends[on] = ~_in(triples.value, h)
            place = np.arange(len(at)) + 2 * (np.cumsum(ends) - ends)
            values = np.full(len(at) + 2 * int(ends.sum()), len(w.word))
            values[place] = w.key[at]
            values[place[ends] + 1] = w.key[at[ends] + 1]
            words = w.word.cast(pa.string()).take(pa.array(values, mask=values == len(w.word)))
            many = np.bincount(w.text[at], weights=1 + 2 * ends, minlength=batch.num_rows).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), words)
            full = pa.array(many > 0)
            yield pa.record_batch([batch.column(1).filter(full), lists.filter(full)], ["lang", "words"])

    return rows.mapInArrow(tidy(run), "lang string, words array<string>")


_WINDOW = [f"w{i}" for i in range(1, LONGEST + 1)]


def window_counts(found: DataFrame) -> DataFrame:
    """lang, w1 to w5 and n of the windows that begin with a pair; null pads a window that ends."""
    lead = ", ".join(f"slice(words, {i}, size(words))" for i in range(1, LONGEST + 1))
    led = found.select("lang", F.expr(f"inline(arrays_zip({lead}))").alias(*_WINDOW)).where("w1 IS NOT NULL AND w2 IS NOT NULL")
    for before, name in zip(_WINDOW[2:], _WINDOW[3:]):
        led = led.withColumn(name, F.when(F.col(before).isNotNull(), F.col(name)))
    return led.groupBy("lang", *_WINDOW).agg(F.count(F.lit(1)).alias("n"))


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n of the phrases of two words and more that occur at least ``least`` times.

    ROLLUP sums a window's n for the window and each shorter prefix; a prefix that
    ends in padding is none.
    """
    rolled = windows.rollup(F.struct("lang", "w1", "w2").alias("head"), *_WINDOW[2:]).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    last = F.expr("CASE level WHEN 0 THEN w5 WHEN 1 THEN w4 WHEN 3 THEN w3 WHEN 7 THEN head.w2 END")
    found = rolled.where((F.col("n") >= least) & last.isNotNull())
    return found.select("head.lang", F.concat_ws(" ", "head.w1", "head.w2", *_WINDOW[2:]).alias("phrase"), "n")


# --- scores ---


def _part(words: str, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates: the lowest-scoring cut of each.

    ``phrases``: lang, phrase and n of all words and phrases that are frequent;
    ``sizes``: lang and n of all words.
    """
    words = F.split("phrase", " ")
    several = phrases.withColumn("words", words).where(F.size("words") > 1)
    cuts = several.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("words", 1, F.col("k")).alias("left"), _part("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    of_left = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    of_right = phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    found = cuts.join(of_left, ["lang", "left"]).join(of_right, ["lang", "right"]).join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * da * dn) DIV (dl * dr)")
    found = found.withColumns({f"d{c}": exact(c) for c in "anlr"}).withColumn("score", score)
    best = found.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _inside(scores: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of the candidates that lie inside a longer one which is ``percent`` as frequent."""
    words = scores.select("lang", F.split("phrase", " ").alias("words"), "a").where(F.size("words") > 2)
    at = F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), s -> struct(s, m))))"))
    parts = words.select("lang", "words", "a", at.alias("at")).select("lang", _part("words", F.col("at.s"), F.col("at.m")).alias("phrase"), "a")
    longest = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = scores.select("lang", "phrase", "a").join(longest, ["lang", "phrase"])
    return held.where(100 * F.col("longer") >= percent * F.col("a")).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2_000, percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` best phrases of two to five words.

    a, l, r: occurrences of the phrase and of its parts at the lowest-scoring cut; n:
    all words of the language; score: floor(1000 a n / (l r)). A phrase inside a longer
    one that occurs at least ``percent`` percent as often is left out.
    """
    context, rows = docs.sparkSession.sparkContext, _texts(docs, text_col, lang_col)
    every = written(word_counts(rows), "words")
    often = every.where(F.col("n") >= least)
    frequent = context.broadcast(bloom(often.select(_hash(F.col("phrase")).alias("h"))))
    sizes = written(every.groupBy("lang").agg(F.sum("n").alias("n")), "language-sizes")
    words = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = context.broadcast(frequent_buckets(rows, lambda w: _pair_hashes(w, frequent.value), words, least))
    triples = context.broadcast(frequent_buckets(rows, lambda w: _linked(w, frequent.value, pairs.value)[2], words, least))
    phrases = written(phrase_counts(window_counts(runs(rows, frequent, pairs, triples)), least).unionByName(often), "phrases")
    drop_written(every)
    scores = written(scored(phrases, sizes), "collocations")
    for table in (phrases, sizes):
        drop_written(table)
    kept = scores.join(_inside(scores, percent), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM d)
), g AS (
  SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p), (SELECT unnest(range(1, 6)) AS k)
  WHERE i + k - 1 <= len(ws) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 100
), s AS (
  SELECT c.lang, c.phrase, c.a, c.ws, x.cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) x
  JOIN c ON c.lang = x.lang AND c.phrase = x.phrase
  JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1 : x.cut], ' ')
  JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1 :], ' ')
  JOIN n ON n.lang = x.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), i AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT c.*, unnest(range(1, k + 1)) AS i FROM c), (SELECT unnest(range(2, 5)) AS m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), o AS (
  SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a
)
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= 2000
"""
