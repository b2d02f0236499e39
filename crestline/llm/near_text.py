"""Near-duplicate texts by exact Jaccard similarity of word shingles.

Two texts are linked if their sets of ``WIDTH``-word shingles (hashes; words as for
SimHash) have a Jaccard similarity of ``LEAST`` or more; links form components.

Candidates come from SimHash first: a set's fingerprint is the majority of its hashes'
bits, and ``simhash.near_links`` finds the fingerprints within ``BITS`` bits by the
general pigeonhole principle. Each fingerprint's sets are compared with one of them,
and that one with the one of the least fingerprint in range, so pairs to verify are
at most as many as sets and fingerprints. What is linked so is one component where
the bands, as below, add links.

No radius at an acceptable cost finds all links. Sets with a similarity of 0.8 have a
cosine of 0.89; a bit of the fingerprint then differs with a chance of 0.15, 9.8 of
64 on average, and 18 must be allowed to find all but a few in a thousand, where
texts without anything in common differ in 32. The best partitions for even 11 bits,
four of 16 bits with a threshold of 2 each, make 0.8 % of all documents candidates of
each. The links beyond ``BITS`` come from MinHash: ``BANDS`` bands of ``ROWS``
minima, and texts that share a band are compared. A pair at 0.8 shares none of 20
bands of 4 with a chance of (1 - 0.8^4)^20 = 2.6e-5, a closer one with less. Every
link, of either kind, is verified on the whole sets, as 32-bit hashes.

A band isn't paired out in rows. The sets of a band of at most ``CHUNK`` nodes meet
in one cell, a task counts their overlaps by products of matrices and gives the links
of a spanning forest; bands with the same members meet once. In a larger band each
member is first compared with one member, drawn anew in each round, and what is
linked is one component. If several components are left, their members are cut into
chunks and every two chunks meet in a cell: those outside of the band's largest
component with each other and with it, so that many copies of one text with few
others beside them cost in proportion to their number. The components are those
that all pairs of all bands would give, and no cell has over about two chunks.

Cases: a null text is empty; texts without words have the empty set, and equal
sets are one node; fewer words than a shingle make one shingle; null identifiers
sort last; of rows that repeat a component's smallest identifier the one whose text
hashes lowest stays, and rows that repeat its text too stay with it; an empty table
gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm import simhash
from crestline.llm.common import drop_written, slices, text_or_empty, tidy, written
from crestline.llm.components import connected_components
from crestline.llm.ownership import owned, row_hash, without_rows

SEED, WIDTH, BANDS, ROWS, LEAST = 42, 5, 20, 4, 0.8
#: The radius of the fingerprints' search.
BITS = 3
_CHUNK = 1 << 14
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTORS, _SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]
#: Nodes of a chunk, tokens of a matrix, and rounds of one comparison a member in bands of more than a chunk.
CHUNK, _TOKENS, _ROUNDS = 256, 4096, 2


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's word shingles, in order."""
    words = text.lower().split()  # of bytes: A-Z, and the ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of a set's minima; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (_FACTORS * hashes[at : at + _CHUNK] + _SHIFTS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text), node (a digest of the set), fp (its fingerprint as a signed long), n (its size), bands and hashes of every row."""

    def run(batches):
        for part in slices(batches, 200):
            sets = [shingles(t) for t in part.column(2).to_pylist()]
            nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64))
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            sets = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
            sizes = [len(s) for s in sets]
            hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(sets).view(np.int32)))
            yield pa.record_batch([part.column(0), part.column(1), nodes, fps, pa.array(sizes, pa.int32()), keys, hashes], ["doc_id", "row", "node", "fp", "n", "bands", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"), text_or_empty(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), "doc_id long, row long, node binary, fp long, n int, bands array<long>, hashes array<int>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    same = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").where(same / (F.size("ha") + F.size("hb") - same) >= LEAST).select("a", "b")


def _similar_sizes(m: str, n: str):
    return F.least(m, n) / F.greatest(m, n) >= LEAST


def _paired(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def fingerprint_heads(rows: DataFrame) -> DataFrame:
    """Of each fingerprint fp: one of its sets, node, with its size n, and whether there are others, several."""
    heads = rows.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head"), F.max("node").alias("high"))
    return heads.select("fp", "head.node", "head.n", (F.col("head.node") != F.col("high")).alias("several"))


def fingerprint_pairs(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates (a, b) of sets whose fingerprints lie within ``BITS`` bits; ``heads`` is a written table.

    A fingerprint's other sets are paired with its head, and heads with that of the
    least fingerprint in range.
    """
    # fingerprints are hashed for the join, so that a frequent one can be split
    shared = heads.where("several").select(F.xxhash64("fp").alias("k"), F.col("node").alias("other"), F.col("n").alias("m"))
    same = rows.select(F.xxhash64("fp").alias("k"), "node", "n").join(shared, "k")
    near = simhash.near_links(heads, BITS).groupBy("b").agg(F.min("a").alias("a"))
    of = lambda fp, node, n: heads.select(F.col("fp").alias(fp), F.col("node").alias(node), F.col("n").alias(n))
    across = near.join(of("a", "other", "m"), "a").join(of("b", "node", "n"), "b")
    found = same.select("node", "n", "other", "m").unionByName(across.select("node", "n", "other", "m"))
    return _paired(found.where((F.col("node") != F.col("other")) & _similar_sizes("n", "m")))


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component's root."""
    return members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))


def _of_several(placed: DataFrame) -> DataFrame:
    """The members of bands that have several components."""
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.xxhash64("key").alias("k"))
    return placed.withColumn("k", F.xxhash64("key")).join(several, "k", "left_semi").drop("k")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes every two sets share."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[token] > 1
    row, (_, token) = row[shared], np.unique(token[shared], return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, _TOKENS):
        s, e = np.searchsorted(token, (first, first + _TOKENS))
        part = np.zeros((len(sets), min(_TOKENS, int(token[-1]) + 1 - first)), np.float32)
        part[row[s:e], token[s:e] - first] = 1
        out += part @ part.T
    return out


def forest(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links between similar sets, no more than join what isn't in one component yet; ``side``: only across two sides."""
    same, size = overlaps(sets), np.array([len(s) for s in sets], np.float64)
    either = size[:, None] + size[None, :] - same
    near = same >= LEAST * np.maximum(either, 1) - 1e-9
    if side is not None:
        near &= side[:, None] != side[None, :]
    out, label = [], np.unique(label, return_inverse=True)[1]
    for i in range(len(sets)):
        found = np.flatnonzero(near[i] & (label != label[i]))
        for x, j in zip(*np.unique(label[found], return_index=True), strict=True):
            out.append((i, int(found[j])))
            label[label == x] = label[i]
    return out


def _cell_links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within cells of (key, i, j, side, node, root); across sides where i and j differ."""

    def run(cell: pa.Table) -> pa.Table:
        nodes = cell["node"].to_pylist()
        hashes = [np.asarray(x.values) for x in cell["hashes"]]
        across = cell["i"][0] != cell["j"][0]
        found = forest(hashes, np.array([r.hex() for r in cell["root"].to_pylist()]), cell["side"].to_numpy() if across else None)
        return pa.table({"a": pa.array([min(nodes[i], nodes[j]) for i, j in found], pa.binary()), "b": pa.array([max(nodes[i], nodes[j]) for i, j in found], pa.binary())})

    return cells.join(sets, "node").groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def _crossed(live: DataFrame) -> DataFrame:
    """Cells in which all members of a band that are in different components meet."""
    parts = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"))
    big = parts.groupBy("key").agg(F.max(F.struct("many", "root")).alias("big"), F.sum("many").alias("all"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    big = big.select(F.xxhash64("key").alias("k"), F.col("big.root").alias("top"), chunks(F.col("big.many")).alias("many_big"), chunks(F.col("all") - F.col("big.many")).alias("many_rest"))
    own = live.withColumn("k", F.xxhash64("key")).join(big, "k").withColumn("is_big", F.col("root") == F.col("top"))
    own = own.withColumn("c", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("is_big"), F.col("many_big")).otherwise(F.col("many_rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    beyond = lambda x: F.col("many_rest") + x  # noqa: E731  the big component's chunks are numbered after the others
    of_big = F.transform(upto(F.col("many_rest")), lambda x: cell(x, beyond(F.col("c")), F.lit(1)))
    of_rest = F.transform(upto(F.col("many_rest")), lambda x: cell(F.least(x, F.col("c")), F.greatest(x, F.col("c")), F.col("c") > x))
    with_big = F.transform(upto(F.col("many_big")), lambda x: cell(F.col("c"), beyond(x), F.lit(0)))
    return own.select("key", "node", "root", F.explode(F.when(F.col("is_big"), of_big).otherwise(F.concat(of_rest, with_big))).alias("at")).select("key", "at.i", "at.j", "at.side", "node", "root")


def near_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between similar nodes of a written table of sketches, enough for their components."""
    passing: list[DataFrame] = []
    links = _links(rows, passing)
    for table in passing:
        drop_written(table)
    return links


def _links(rows: DataFrame, passing: list[DataFrame]) -> DataFrame:
    """The same; tables that links don't read go into ``passing``."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        passing.append(written(df, name))
        return passing[-1]

    close = kept(fingerprint_pairs(rows, kept(fingerprint_heads(rows), "near-fingerprints")), "near-fingerprint-pairs")
    banded = rows.select(F.explode("bands").alias("key"), "node", "n")
    # keys are hashed for the join, so that it deals rows anew and can split a frequent key
    ends = banded.groupBy("key").agg(F.min(F.xxhash64("node")).alias("low"), F.max(F.xxhash64("node")).alias("high"))
    ends = ends.where("low <> high").select(F.xxhash64("key").alias("k"))
    members = kept(banded.withColumn("k", F.xxhash64("key")).join(ends, "k", "left_semi").drop("k").distinct(), "band-members")
    wanted = members.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = kept(rows.select("node", "hashes").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "shingle-sets")
    links = written(_verified(close, sets), "near-links")
    # of bands with the same members one is enough
    alike = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    bands_kept = kept(alike.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select(F.xxhash64("key").alias("k"), "size"), "bands")
    of_size = lambda when: members.withColumn("k", F.xxhash64("key")).join(bands_kept.where(when).select("k"), "k", "left_semi").drop("k")
    none = F.lit(0)
    # what fingerprints have linked is one component in its cells
    cells = _placed(of_size(F.col("size") <= CHUNK), connected_components(links, "a", "b")).select("key", none.alias("i"), none.alias("j"), none.alias("side"), "node", "root")
    links = links.unionByName(written(_cell_links(cells, sets), "near-links"))
    if bands_kept.where(F.col("size") > CHUNK).isEmpty():
        return links
    large = kept(of_size(F.col("size") > CHUNK), "large-bands")
    for turn in range(_ROUNDS + 1):
        placed = kept(_placed(large, connected_components(links, "a", "b")), "placed")
        live = kept(_of_several(placed), "live")
        if live.isEmpty():
            return links
        if turn == _ROUNDS:
            return links.unionByName(written(_cell_links(_crossed(live), sets), "near-links"))
        drawn = live.withColumn("h", F.xxhash64("node", F.lit(turn)))
        heads = drawn.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), "h").alias("head")).select(F.xxhash64("key").alias("k"), "head.*").toDF("k", "other", "m", "top")
        pairs = live.withColumn("k", F.xxhash64("key")).join(heads, "k").where((F.col("root") != F.col("top")) & _similar_sizes("n", "m"))
        links = links.unionByName(written(_verified(_paired(pairs), sets), "near-links"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, component_id (the smallest identifier reachable) and stays of every row."""
    rows = written(sketches(docs, id_col, text_col), "sketches")
    roots = connected_components(near_links(rows), "a", "b")
    return owned(rows.select("doc_id", "row", "node"), roots)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that own a component."""
    return without_rows(docs, near_components(docs, id_col, text_col), id_col, text_col)
