"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from crestline.llm import hnsw
from crestline.llm.registry import op11_nearest_neighbours

DIR = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k=5):
    """(query_id, rank) -> (vec_id, score) by all cosines; ``rows`` and ``asked``: identifiers and vectors."""
    out = {}
    for q, v in asked:
        v, left, found = np.asarray(v, float), 1, []
        for i, w in rows:
            w = np.asarray(w, float)
            if left and i == q and np.array_equal(v, w):
                left = 0
                continue
            if len(w) == len(v):
                found.append((-float((v * w).sum() / np.sqrt((v * v).sum() * (w * w).sum())), i))
        for rank, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in found)[:k], 1):
            out[q, rank] = (i, -s)
    return out


def results(frame):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in frame.collect()}


def test_recall_of_whole_table(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet")
    plain = [(r.vec_id, r.embedding) for r in rows.collect()]
    want, got = brute(plain, [x for x in plain if x[0] % 50 == 0]), results(op11_nearest_neighbours(spark, DIR))
    assert got.keys() == want.keys()
    assert np.mean([got[k][0] == want[k][0] for k in want]) > 0.95
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want if got[k][0] == want[k][0])


@pytest.mark.parametrize("shard_rows, block_rows", [(40, 7), (300, 1_000), (10_000, 10_000)])
def test_shards_blocks_and_clusters(spark, shard_rows, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    plain = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(600)]
    rows = spark.createDataFrame(plain, SCHEMA)
    want = brute(plain, plain[::20])
    got = results(hnsw.nearest(rows, rows.where("vec_id % 20 = 0"), shard_rows=shard_rows, block_rows=block_rows))
    assert got.keys() == want.keys()
    assert np.mean([got[k][0] == want[k][0] for k in want]) > 0.97


def test_copies_and_ties(spark):
    """A third of the rows are one vector: their ties go to the smallest identifiers, whoever asks."""
    rng = np.random.default_rng(5)
    plain = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=3).astype(np.float32).tolist()) for i in range(300)]
    rows = spark.createDataFrame(plain, SCHEMA)
    got = results(hnsw.nearest(rows, rows.where("vec_id IN (0, 3, 150)"), shard_rows=50))
    assert [got[0, r][0] for r in range(1, 6)] == [3, 6, 9, 12, 15]
    assert [got[3, r][0] for r in range(1, 6)] == [0, 6, 9, 12, 15]
    assert [got[150, r][0] for r in range(1, 6)] == [0, 3, 6, 9, 12]
    assert all(got[q, r][1] == 1.0 for q in (0, 3, 150) for r in range(1, 6))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    plain = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (50, [1e-30, 0.0])]
    rows = spark.createDataFrame([(*x, "clash", 1.0) for x in plain], SCHEMA + ", query_id string, SCORE double")
    got = results(hnsw.nearest(rows, rows.where("vec_id IN (0, 1, 4, 8) OR vec_id IS NULL")))
    assert {q for q, _ in got} == {0, 1}  # the others take no part, or have no vector of their length
    assert [got[0, r][0] for r in range(1, 5)] == [50, None, 1, 1]
    assert [got[1, r][0] for r in range(1, 5)] == [1, None, 0, 50]
    assert (0, 5) not in got and (1, 5) not in got
    assert got[0, 1][1] == 1.0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hnsw.nearest(none, none).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)
    assert hnsw.nearest(one, one).collect() == []


def test_layers_and_links():
    rng = np.random.default_rng(1)
    unit = hnsw.unit_of(rng.normal(size=(1_500, 12)))
    graph = hnsw.build(unit, [1_500, 90, 6])
    assert [len(x) for x in graph.layers] == [1_500, 90, 6]
    for near in graph.layers:
        assert near.max() < len(near)
        for i, row in enumerate(near):
            held = row[row >= 0]
            assert len(set(held)) == len(held) and i not in held and len(held)
    want = np.argsort(-(unit[:100] @ unit.T), axis=1)[:, :5]
    got = hnsw.search(graph, unit[:100], 60)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(want, got, strict=True)]) > 0.95
