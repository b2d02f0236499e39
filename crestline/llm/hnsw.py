"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt into shards by a hash. A task builds the graph of a shard
(Malkov and Yashunin, 2018): every node is on layer 0 and, with a chance of 1 / M for
each, on layers above. A layer is one flat array of neighbours, a row of fixed width
for each of its nodes. Nodes are numbered from the highest layer down, so a layer's
nodes are the first so many, and layers are built from the top, each entered through
those above. Nodes come in groups that double up to a fixed size: a group's searches
run as one beam over arrays, and its members see each other through one product of
matrices. Neighbours are picked by the paper's heuristic, farther ones filling up.

The graphs are written as a table. Queries meet every shard, in blocks: both sides are
repeated for pairs of a shard and a block and cogrouped, so that a task holds one of
each. What the beam finds is scored anew in double precision on the original vectors;
each shard gives a query's best rows, and these are merged by a window that keeps a
few rows a query and task before its shuffle.

Equal vectors are one node that carries the smallest identifiers of its rows, one more
than a query wants: no other row of them can be in a result. So copies, however many,
neither skew a shard nor crowd a beam, and their ties come out exactly.

Cases: vectors that are null, empty, zero or hold a null or non-finite component take
no part; vectors are compared with those of their own length; a null identifier is the
largest and asks nothing; a query leaves out one row, itself, so that other rows of its
identifier are candidates; queries that repeat identifier and vector are one; with
fewer candidates all are returned; an empty table gives an empty result; other columns
may have any names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import drop_written, give_back, written

#: Links of a node when it is added; a layer's rows have room for twice as many.
LINKS = 16
#: Nodes searched at once, and expanded in each of a beam's steps.
_GROUP, _STEP = 256, 4


class Graph(NamedTuple):
    """Unit vectors in single precision, and for each layer, 0 first, a row of neighbours for each of its nodes, -1 where free."""

    unit: np.ndarray
    layers: list[np.ndarray]


def _beam(unit: np.ndarray, near: np.ndarray, asked: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the best ``width`` found from ``start`` in a layer, for each of the asked vectors, best first; -1 where fewer."""
    n, rows = len(near), np.arange(len(asked))
    seen = np.zeros((len(asked), n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    seen[rows, start] = True
    node, done = np.full((len(asked), width), -1), np.zeros((len(asked), width), bool)
    like = np.full((len(asked), width), -np.inf, np.float32)
    node[:, 0], like[:, 0] = start, np.einsum("qd,qd->q", unit[start], asked)
    step = min(_STEP, width)
    live = rows
    while len(live):
        waiting = np.where(done[live], -np.inf, like[live])
        picks = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        open_ = np.take_along_axis(waiting, picks, 1) > -np.inf
        going = open_.any(axis=1)
        live, picks, open_ = live[going], picks[going], open_[going]
        if not len(live):
            break
        done[live[:, None], picks] = True
        found = np.where(open_[:, :, None], near[np.take_along_axis(node[live], picks, 1)], -1).reshape(len(live), -1)
        found[found < 0] = n
        found.sort(axis=1)  # a node that two expanded ones have in common counts once
        fresh = ~seen[live[:, None], found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[live[:, None], found] = True
        found[~fresh] = 0
        score = np.matmul(unit[found], asked[live][:, :, None])[:, :, 0]
        score[~fresh] = -np.inf
        every = np.concatenate([like[live], score], axis=1)
        best = np.argpartition(-every, width - 1, axis=1)[:, :width]
        like[live] = np.take_along_axis(every, best, 1)
        node[live] = np.take_along_axis(np.concatenate([node[live], found], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(found.shape, bool)], axis=1), best, 1)
    order = np.argsort(-like, axis=1, kind="stable")
    like = np.take_along_axis(like, order, 1)
    return np.where(like > -np.inf, np.take_along_axis(node, order, 1), -1), like


def _picked(unit: np.ndarray, found: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row of nodes, which come best first: those nearer to the row's own than to any picked, then the others."""
    out = np.full((len(found), most), -1)
    for at in range(0, len(found), _GROUP):
        part, own = found[at : at + _GROUP], like[at : at + _GROUP]
        vectors = unit[np.maximum(part, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        free, taken = part >= 0, np.zeros(part.shape, bool)
        spare = free.copy()
        for j in range(part.shape[1]):
            take = free[:, j] & (taken.sum(axis=1) < most)
            taken[:, j] = take
            free &= ~(take[:, None] & (between[:, j] > own))
        rank = np.where(taken, 0, np.where(spare, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        nodes = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(part, order, 1), -1)
        out[at : at + len(part), : nodes.shape[1]] = nodes
    return out


def _link_back(unit: np.ndarray, near: np.ndarray, first: int, links: np.ndarray) -> None:
    """Add the new nodes, numbered from ``first``, to the rows of those they link to; a full row is picked anew."""
    a, b = np.nonzero(links >= 0)
    to, new = links[a, b], first + a
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    target, begin, many = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(begin, many)
    wide = np.full((len(target), near.shape[1] + int(many.max(initial=0))), -1)
    wide[:, : near.shape[1]] = near[target]
    wide[np.repeat(np.arange(len(target)), many), near.shape[1] + place] = new
    like = np.where(wide >= 0, np.matmul(unit[np.maximum(wide, 0)], unit[target][:, :, None])[:, :, 0], -np.inf)
    order = np.argsort(-like, axis=1, kind="stable")
    wide, like = np.take_along_axis(wide, order, 1), np.take_along_axis(like, order, 1)
    full = (wide >= 0).sum(axis=1) > near.shape[1]
    near[target[~full]] = wide[~full][:, : near.shape[1]]
    if full.any():
        near[target[full]] = _picked(unit, wide[full], like[full], near.shape[1])


def build(unit: np.ndarray, sizes: list[int], width: int = 100) -> Graph:
    """The graph of unit vectors; ``sizes``: how many of them, from the first, are on each layer, 0 first."""
    layers: list[np.ndarray] = []  # the top first, while building
    for depth, size in enumerate(reversed(sizes)):
        near = np.full((size, 2 * LINKS), -1, np.int32)
        above = len(layers[-1]) if depth else 0
        at = 1  # node 0 is the entry
        while at < size:
            group = np.arange(at, min(size, at + min(at, _GROUP)))
            start = np.zeros(len(group), np.int64)
            if above and at >= above:  # all nodes of the layers above are in this one by now
                start = _descended(Graph(unit, layers[::-1]), unit[group])
            found, like = _beam(unit, near[:at], unit[group], start, min(width, at))
            among = unit[group] @ unit[group].T
            among[np.triu_indices(len(group))] = -np.inf  # earlier members only
            found = np.concatenate([found, np.broadcast_to(group, among.shape)], axis=1)
            like = np.concatenate([like, among], axis=1)
            order = np.argsort(-like, axis=1, kind="stable")[:, :width]
            like = np.take_along_axis(like, order, 1)
            found = np.where(like > -np.inf, np.take_along_axis(found, order, 1), -1)
            links = _picked(unit, found, like, LINKS)
            near[group, :LINKS] = links
            _link_back(unit, near, at, links)
            at += len(group)
        layers.append(near)
    return Graph(unit, layers[::-1])


def _descended(graph: Graph, asked: np.ndarray) -> np.ndarray:
    """The nearest node that a greedy walk from the top finds in the lowest of the graph's layers."""
    start = np.zeros(len(asked), np.int64)
    for near in reversed(graph.layers):
        start = _beam(graph.unit, near, asked, start, 1)[0][:, 0]
    return start


def search(graph: Graph, asked: np.ndarray, width: int) -> np.ndarray:
    """The nodes that a beam of ``width`` finds for each unit vector, best first; -1 where fewer."""
    out = np.full((len(asked), width), -1)
    for at in range(0, len(asked), _GROUP):
        part = asked[at : at + _GROUP]
        start = _descended(Graph(graph.unit, graph.layers[1:]), part) if len(graph.layers) > 1 else np.zeros(len(part), np.int64)
        out[at : at + len(part)] = _beam(graph.unit, graph.layers[0], part, start, width)[0]
    return out


def unit_of(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in single precision; scaled first, as squares may leave the range."""
    scaled = vectors / np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row's vector in ``a`` with each of its vectors in ``b``, in double precision."""
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    dot = (a[:, None, :] * b).sum(axis=-1)
    return dot / np.sqrt((a * a).sum(axis=-1)[:, None] * (b * b).sum(axis=-1))


# --- Spark ---


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """vec and ids, its rows' smallest identifiers, at most ``ids``, of each distinct vector."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last()))
    least = rows.withColumn("place", place).where(F.col("place") <= ids)
    return least.groupBy("vec").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return np.asarray(column.combine_chunks().values if isinstance(column, pa.ChunkedArray) else column.values, np.float64).reshape(len(column), -1)


_GRAPH = "dim int, shard int, vectors binary, ids array<array<bigint>>, sizes array<int>, near binary"


def graphs(vectors: DataFrame, shards: int, width: int = 100) -> DataFrame:
    """A row for each shard of the distinct vectors: its vectors, identifiers, the sizes of its layers and their neighbours, one after another."""

    def run(key: tuple, shard: pa.Table) -> pa.Table:
        rank = np.asarray(shard["rank"])
        # the highest layer first; a rank is a hash, so its leading zeros in base M tell the layer
        order = np.lexsort((rank, np.asarray(shard["layer"])))[::-1]
        layer = np.asarray(shard["layer"])[order]
        shard = shard.take(pa.array(order))
        vectors = _matrix(shard["vec"])
        sizes = [int((layer >= x).sum()) for x in range(int(layer[0]) + 1)]
        graph = build(unit_of(vectors), sizes, width)
        near = b"".join(x.tobytes() for x in graph.layers)
        out = pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "vectors": pa.array([vectors.tobytes()], pa.binary()), "ids": pa.array([shard["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))), "sizes": pa.array([sizes], pa.list_(pa.int32())), "near": pa.array([near], pa.binary())})
        give_back()
        return out

    chance = (F.xxhash64("vec", F.lit(1)).bitwiseAND((1 << 48) - 1) + 1) / F.lit(float(1 << 48))
    layer = F.floor(-F.log(chance) / float(np.log(LINKS))).cast("int")
    dealt = vectors.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "ids", layer.alias("layer"), F.xxhash64("vec", F.lit(2)).alias("rank"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, _GRAPH)


def _found(index: DataFrame, queries: DataFrame, blocks: int, shards: int, k: int, width: int) -> DataFrame:
    """query_id, query (a hash of its vector), vec_id, score: each shard's ``k`` best rows for each query."""

    def run(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["query_id", "query", "vec_id", "score"]
        if not len(asked) or not len(shard):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], names)
        dim, sizes = key[0].as_py(), shard["sizes"][0].as_py()
        vectors = np.frombuffer(shard["vectors"][0].as_py(), np.float64).reshape(-1, dim)
        near = np.frombuffer(shard["near"][0].as_py(), np.int32).reshape(-1, 2 * LINKS)
        ids = shard["ids"][0].as_py()
        layers = np.split(near, np.cumsum(sizes)[:-1])
        wanted, own = _matrix(asked["vec"]), asked["query_id"].to_pylist()
        out: list[list] = [[], [], [], []]
        graph, asking = Graph(unit_of(vectors), layers), unit_of(wanted)
        hashes = asked["query"].to_pylist()
        for at in range(0, len(own), _GROUP):
            nodes = search(graph, asking[at : at + _GROUP], width)
            mine = wanted[at : at + _GROUP]
            score = np.where(nodes >= 0, cosines(mine, vectors[np.maximum(nodes, 0)]), -np.inf)
            best = np.argsort(-score, axis=1, kind="stable")
            for i, row in enumerate(best):
                rows, left, last = [], own[at + i], None
                for j in row:
                    s = float(score[i, j])
                    if s == -np.inf or len(rows) >= k and s < last:
                        break  # of equal scores all are looked at
                    of = ids[nodes[i, j]]
                    if left in of and np.array_equal(vectors[nodes[i, j]], mine[i]):
                        of, left = of[: of.index(left)] + of[of.index(left) + 1 :], None
                    rows += [(-s, x is None, x) for x in of]
                    last = s
                rows.sort(key=lambda x: (x[0], x[1], x[2] or 0))
                for s, _, x in rows[:k]:
                    for column, value in zip(out, (own[at + i], hashes[at + i], x, -s), strict=True):
                        column.append(value)
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names)

    keys = ["dim", "shard", "block"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("shard", every(shards)).groupBy(*keys)
    return asked.cogroup(index.withColumn("block", every(blocks)).groupBy(*keys)).applyInArrow(run, "query_id long, query long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, shard_rows: int = 4_096, block_rows: int = 4_096, build_width: int = 100, width: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``rows`` found for each of ``queries``, both with an identifier and a vector.

    Larger widths find more and take longer. ``shard_rows`` and ``block_rows`` bound
    what a task holds; larger shards make less work in all.
    """
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")))
    vectors = written(distinct_vectors(plain(rows), k + 1), "vectors")
    asked = plain(queries).where("vec_id IS NOT NULL").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    asked = written(asked.select("query_id", "vec", F.size("vec").alias("dim"), F.xxhash64("vec").alias("query")), "queries")
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    index = written(graphs(vectors, shards, build_width), "graphs")
    drop_written(vectors)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)).cast("int"))
    found = _found(index, asked, blocks, shards, k, max(width, k + 1))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
