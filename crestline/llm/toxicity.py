"""Toxicity by votes of the nearest labelled examples.

Terms are words in lower case; the vector space is that of all words the examples
have. A text's vector has (1 + ln tf) idf tie for each of them: idf counts every
document of the corpus, and tie = ``floor`` + max(0, ln(rate of the label among
the examples with the word / rate among all)), the former shrunk by one example,
so that words that go with the label weigh more and no word is left out. Cosines
are exact.

The index has the examples' vectors in blocks of similar ones. The postings of
rarer terms are added up at once; the ``common`` terms that most examples have are
stored by block, with the largest weight of each in every block. A search bounds
all blocks by what the rarer terms gave and by those weights, visits them from the
highest bound down, and stops where no further block can reach the k-th neighbour;
what may be among the k nearest is then computed anew in double precision. Many
texts are searched for at once, so that a block's work is a product of matrices.
Votes are weighted by closeness, and calibrated by isotonic regression on the votes
of the examples themselves, each left out of its own.

Examples are at most ``max_examples`` labelled rows, those whose identifiers hash
lowest, with ``max_chars`` characters at most together; a text counts whole or not
at all. Their words, the corpus counts of those and the votes of the calibration
are all that reaches the driver. Every document is counted and scored where it
lies, from its whole text.

Cases: a text without a word of the examples, a null or empty one above all,
scores as the examples' rate; places for which no example shares a word vote that
rate too; without labels, or with those of one kind only, all score 0 or 1; several
labels of one identifier count as toxic if one is; of rows that repeat a labelled
identifier the least text is the example; rows with a null identifier have no
label; equal texts score alike; an empty table gives an empty result; other
columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import give_back, slices, text_or_empty, tidy, written

WORD = re.compile(r"[^\W\d_]+")
#: More than single precision loses in a cosine.
_MARGIN = 1e-4


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the identifier as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Params:
    """``k``: examples that vote; ``block``: vectors in a block; the others as in the module's text."""

    k: int = 15
    floor: float = 0.05
    max_examples: int = 3_000
    max_chars: int = 64_000_000
    block: int = 64
    common: int = 512
    threshold: float = 0.7


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, params: Params) -> DataFrame:
    """id, text and toxic (0 or 1) of the examples: one row of each identifier, within the parameters' bounds."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(F.col("id").isNotNull() & ~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(params.max_examples)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # max_examples rows of two numbers, so a broadcast, and max_examples lengths in one task
    found = written(rows.join(F.broadcast(marks), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "examples")
    upto = F.sum("chars").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = found.select("id", F.length("text").cast("long").alias("chars")).withColumn("upto", upto).where(F.col("upto") <= params.max_chars).select("id")
    return found.join(F.broadcast(within), "id")


def word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


@dataclass
class Examples:
    """Examples by identifier, and their words: those of row i lie from ``start[i]`` on; ``word`` is a number in ``words``."""

    id: np.ndarray
    toxic: np.ndarray
    words: list[str]
    start: np.ndarray
    word: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, Counter]]) -> Examples:
        rows = sorted(rows, key=lambda x: x[0])
        words = sorted({w for *_, c in rows for w in c})
        number = {w: i for i, w in enumerate(words)}
        flat = [(number[w], n) for *_, c in rows for w, n in c.items()]
        word, count = np.array(flat, np.int64).reshape(-1, 2).T
        return cls(np.array([i for i, *_ in rows], np.int64), np.array([t for _, t, _ in rows], np.float64), words, np.cumsum([0, *(len(c) for *_, c in rows)]), word, count)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.id)), np.diff(self.start))

    @property
    def rate(self) -> float:
        return float(self.toxic.mean()) if len(self.id) else 0.0


def gathered(examples: DataFrame) -> Examples:
    """The examples on the driver; their number is bounded."""

    def run(batches):
        for batch in batches:
            found = [word_counts(t) for t in batch.column(1).to_pylist()]
            words, counts = pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(2), words, counts], ["id", "toxic", "words", "counts"])

    rows = examples.select("id", "text", "toxic").mapInArrow(tidy(run), "id long, toxic int, words array<string>, counts array<int>").toArrow().sort_by("id").combine_chunks()
    coded = pa.compute.list_flatten(rows["words"]).combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    words = coded.dictionary.to_pylist()
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    sizes = pa.compute.list_value_length(rows["words"]).to_numpy()
    counts = pa.compute.list_flatten(rows["counts"]).to_numpy().astype(np.int64)
    return Examples(rows["id"].to_numpy(), rows["toxic"].to_numpy().astype(np.float64), [words[i] for i in order], np.concatenate(([0], np.cumsum(sizes))), number[coded.indices.to_numpy()], counts)


def document_frequencies(docs: DataFrame, words: list[str], text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each word is, and how many documents there are.

    Every task adds up its own counts before they are shuffled, and gives at most
    one row for each word; as many come to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches):
        number, n, rows = shared.value, np.zeros(len(shared.value), np.int64), 0
        for batch in slices(batches):
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                found = [number[w] for w in set(WORD.findall(text.lower())) if w in number]
                n[found] += 1
        (some,) = np.nonzero(n)
        yield pa.record_batch([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(n[some], rows))], ["word", "n"])

    counts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(tidy(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    of = np.zeros(len(words) + 1, np.int64)
    for r in counts:
        of[r.word] = r.n  # -1, the last, has all rows
    return of[:-1], int(of[-1])


def term_weights(df: np.ndarray, rows: int, n: np.ndarray, toxic: np.ndarray, rate: float, floor: float) -> np.ndarray:
    """idf times tie of each term; ``n`` and ``toxic`` count the examples that have it."""
    idf = np.log((1 + rows) / (1 + df)) + 1
    tied = np.log((toxic + rate) / (n + 1) / rate) if 0 < rate < 1 else np.zeros(len(n))
    return idf * (floor + np.maximum(0, tied))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of each, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Index:
    """Block-max inverted index over the examples' vectors; rows are examples in the index's order."""

    def __init__(self, examples: Examples, weight: np.ndarray, params: Params):
        self.k, self.block, self.rate = params.k, params.block, examples.rate
        row, held = examples.row, np.bincount(examples.word, minlength=len(examples.words))
        rank = np.lexsort((np.arange(len(held)), -held))  # terms by how many examples have them
        number = np.empty(len(held), np.int64)
        number[rank] = np.arange(len(held))
        self.words, self.weight = [examples.words[i] for i in rank], weight[rank]
        term = number[examples.word]
        value = (1 + np.log(examples.count)) * self.weight[term]
        value = value / np.sqrt(np.bincount(row, value * value, minlength=len(examples.id)))[row]
        # texts that share their commonest words, of one language above all, are neighbours, so bounds are tight
        at = np.lexsort((term, row))
        term, value, sizes = term[at], value[at], np.diff(examples.start)
        first = [tuple(term[s : s + min(n, 4)].tolist()) for s, n in zip(examples.start[:-1], sizes, strict=True)]
        order = np.array(sorted(range(len(first)), key=lambda j: (first[j], j)), np.int64)
        self.id, self.toxic = examples.id[order], examples.toxic[order]
        at = _ranges(examples.start[:-1][order], sizes[order])
        self.term, self.value = term[at].astype(np.int32), value[at]  # the vectors, one row after another
        self.start = np.concatenate(([0], np.cumsum(sizes[order]))).astype(np.int64)
        row = np.repeat(np.arange(len(order)), sizes[order])
        self.common = min(params.common, len(held))
        self.rows = -(-len(order) // self.block) * self.block  # the last block is filled up with empty vectors
        dense = self.term < self.common
        self.dense = np.zeros((self.rows, self.common), np.float32)
        self.dense[row[dense], self.term[dense]] = self.value[dense]
        self.largest = self.dense.reshape(self.rows // self.block, self.block, self.common).max(axis=1)
        at = np.flatnonzero(~dense)
        at = at[np.argsort(self.term[at], kind="stable")]
        self.posting_row, self.posting_value = row[at].astype(np.int32), self.value[at].astype(np.float32)
        self.posting_start = np.searchsorted(self.term[at], np.arange(self.common, len(held) + 1))
        self.knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self._loaded()

    def _loaded(self) -> None:
        self.number = {w: i for i, w in enumerate(self.words)}
        self._query = np.zeros(len(self.words))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "_query")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._loaded()

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length weights of a text's words; words that no example has are no terms."""
        number = self.number
        found = {number[w]: n for w, n in counts.items() if w in number}
        terms = np.fromiter(found, np.int64, len(found))
        weights = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.weight[terms]
        return terms, weights / np.sqrt(weights @ weights) if len(found) else weights

    def own_vector(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.start[j], self.start[j + 1]
        return self.term[s:e].astype(np.int64), self.value[s:e]

    def _may_be_near(self, queries: list[tuple[np.ndarray, np.ndarray]], spare: int) -> list[np.ndarray]:
        """For each query all examples that may be among its k + ``spare`` nearest."""
        n, k = len(queries), min(self.k + spare, self.rows)
        sizes = [len(t) for t, _ in queries]
        terms, weights, of = (np.concatenate(x) for x in ([t for t, _ in queries], [w for _, w in queries], [np.full(m, i) for i, m in enumerate(sizes)]))
        common = terms < self.common
        dense = np.zeros((n, self.common), np.float32)
        dense[of[common], terms[common]] = weights[common]
        rare = terms[~common] - self.common
        held = self.posting_start[rare + 1] - self.posting_start[rare]
        at = _ranges(self.posting_start[rare], held)
        cell = np.repeat(of[~common] * self.rows, held) + self.posting_row[at]
        sums = np.bincount(cell, np.repeat(weights[~common], held) * self.posting_value[at], minlength=n * self.rows).astype(np.float32).reshape(n, self.rows)
        blocks = self.rows // self.block
        bounds = sums.reshape(n, blocks, self.block).max(axis=2) + dense @ self.largest.T
        order, scores = np.argsort(-bounds, axis=1, kind="stable"), np.zeros((n, self.rows), np.float32)
        least, at, width = np.zeros(n, np.float32), 0, 2
        while at < blocks:
            turn = order[:, at : at + width]
            needed = np.take_along_axis(bounds, turn, 1) > np.maximum(least[:, None] - _MARGIN, 0)
            if not needed.any():
                break
            for b in np.unique(turn[needed]).tolist():
                (q,) = np.nonzero(((turn == b) & needed).any(axis=1))
                part = slice(b * self.block, (b + 1) * self.block)
                scores[q, part] = sums[q, part] + dense[q] @ self.dense[part].T
            least = np.partition(scores, self.rows - k, axis=1)[:, self.rows - k]
            at, width = at + width, width * 2
        return [np.flatnonzero(x > max(0.0, m - _MARGIN)) for x, m in zip(scores, least.tolist(), strict=True)]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cosines) of each query's k nearest that share a word, the nearest first; exact. ``without``: a row to leave out."""
        if not self.rows or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        out = []
        for i, (found, (terms, weights)) in enumerate(zip(self._may_be_near(queries, 1 if without else 0), queries, strict=True)):
            if without:
                found = found[found != without[i]]
            sizes = self.start[found + 1] - self.start[found]
            at = _ranges(self.start[found], sizes)
            self._query[terms] = weights
            cosines = np.bincount(np.repeat(np.arange(len(found)), sizes), self._query[self.term[at]] * self.value[at], minlength=len(found))
            self._query[terms] = 0
            best = np.lexsort((found, -cosines.round(12)))[: self.k]
            out.append((found[best], cosines[best]))
        return out

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The share of toxic votes, weighted by closeness; places without a neighbour vote the rate at cosine 0."""
        votes, empty = 1 / (0.02 + np.maximum(0.0, 1 - cosines)), (self.k - len(found)) / 1.02
        return float((votes @ self.toxic[found] + empty * self.rate) / (votes.sum() + empty))

    def left_out(self, rows: list[int]) -> list[float]:
        """The votes on examples by the others."""
        return [self.vote(*x) for x in self.nearest([self.own_vector(j) for j in rows], rows)]

    def calibrate(self, votes: list[tuple[float, int]]) -> None:
        """Fit the increasing step function from votes to the share of toxic ones, as knots of means."""
        pools: list[list[float]] = []  # examples, toxic ones, votes
        for vote, label in sorted(votes):
            pools.append([1, label, vote])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            self.knots = np.array([v / n for n, _, v in pools]), np.array([(t + self.rate) / (n + 1) for n, t, _ in pools])

    def score(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """Each text's calibrated score, and the identifiers of its three nearest examples."""
        if not 0 < self.rate < 1:
            return [(self.rate, [])] * len(texts)
        out = []
        for found, cosines in self.nearest([self.vector(word_counts(t)) for t in texts]):
            if len(found):
                # a little of the vote itself keeps the order where calibration is level
                vote = self.vote(found, cosines)
                out.append((min(1.0, max(0.0, 0.99 * float(np.interp(vote, *self.knots)) + 0.01 * vote)), self.id[found[:3]].tolist()))
            else:
                out.append((self.rate, []))
        return out


class _Scorer:
    """An index's scores by text; those of the texts seen of late are kept, ``most`` at once."""

    def __init__(self, index: Index, most: int = 20_000, turn: int = 128):
        self.index, self.most, self.turn, self.known = index, most, turn, {}

    def __call__(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        keys = [xxhash.xxh3_128_digest(t.encode(errors="surrogatepass")) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.known}
        for at in range(0, len(new), self.turn):
            some = list(new)[at : at + self.turn]
            self.known.update(zip(some, self.index.score([new[k] for k in some]), strict=True))
        return [self.known[k] for k in keys]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> Index:
    """The calibrated index of the examples."""
    spark = docs.sparkSession
    examples = gathered(labelled(docs, labels, id_col, text_col, params))
    df, rows = document_frequencies(docs, examples.words, text_col)
    n, toxic = (np.bincount(examples.word, x, minlength=len(examples.words)) for x in (None, examples.toxic[examples.row]))
    index = Index(examples, term_weights(df, rows, n, toxic, examples.rate, params.floor), params)
    if 0 < index.rate < 1:
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            for batch in batches:
                yield pa.record_batch([batch.column(0), pa.array(shared.value.left_out(batch.column(0).to_pylist()), pa.float64())], ["id", "vote"])

        votes = spark.range(0, len(index.id), 1, 16).mapInArrow(tidy(run), "id long, vote double").collect()
        index.calibrate([(r.vote, int(index.toxic[r.id])) for r in votes])
    return index


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (identifiers of the nearest examples) of every row."""
    threshold = params.threshold
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, params))

    def run(batches):
        score_of = _Scorer(shared.value)
        for batch in slices(batches):
            found = score_of(batch.column(1).to_pylist())
            scores = [s for s, _ in found]
            predicted = [int(s >= threshold) for s in scores]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, evidence array<long>")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not predicted toxic.

    Every row is scored by its own text where it lies: a join with the scores
    would shuffle all texts.
    """
    threshold = params.threshold
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, params))

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score_of = _Scorer(shared.value)
        for texts in batches:
            parts = (texts.slice(at, 1_000).to_pylist() for at in range(0, len(texts), 1_000))
            yield pa.array([score < threshold for part in parts for score, _ in score_of(part)], pa.bool_())
        del score_of
        give_back()

    return docs.where(clean(text_or_empty(text_col)))
