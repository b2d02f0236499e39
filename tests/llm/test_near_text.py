import random

import numpy as np
import pytest

from crestline.llm import near_text as N


def jaccard(a: str, b: str) -> float:
    """By words themselves, without hashes."""

    def parts(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in root if find(i) == i)


def corpus(seed: int = 0):
    """Texts with copies in which 0 to 12 of 40 to 200 words are others, chains of copies, and odd rows."""
    rnd = random.Random(seed)
    texts = ["", "one two", "One  two", "a b c d e", "A b c\nd e"]
    for _ in range(40):
        text = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(40, 200))]
        for _ in range(rnd.randrange(1, 6)):
            texts.append(" ".join(text))
            for _ in range(rnd.randrange(5)):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(500)}"
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_are_those_of_brute_force(spark):
    rows = corpus()
    want = kept_by_brute_force(rows)
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"] and sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len({t for _, t in rows}) - 20


def test_the_pipelines_stage_goes_by_jaccard(spark):
    """Two words of 100 are others: far over 2 bits for many such pairs, and over 0.8."""
    import corpus_pipeline as P
    from crestline.llm import simhash

    rnd, rows = random.Random(1), []
    for i in range(12):
        text = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * i, " ".join(text)))
        text[30], text[60] = "x", "y"
        rows.append((2 * i + 1, " ".join(text)))
    assert any((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 2 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    stage = dict(P.STAGES)["simhash_near_dedup"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows) == [2 * i for i in range(12)]


def test_large_groups_are_whole(spark, monkeypatch):
    """Every text is near the next, the ends are far apart: one component, with and without rounds before all pairs."""
    rnd = random.Random(2)
    text, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[rnd.randrange(100)] = f"x{i}"
    assert jaccard(rows[0][1], rows[-1][1]) < 0.3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in N.keep_one(docs).collect()] == [0]
    for chunk, rounds in ((4, 0), (4, 2), (16, 1)):
        monkeypatch.setattr(N, "CHUNK", chunk)
        monkeypatch.setattr(N, "_ROUNDS", rounds)
        assert [r.doc_id for r in N.keep_one(docs).collect()] == [0]


@pytest.mark.parametrize(("chunk", "rounds"), [(256, 2), (8, 2), (3, 0), (2, 1)])
def test_crowded_bands_lose_no_link(spark, monkeypatch, chunk, rounds):
    """Copies of one text with so many edits that some pairs are near and most are not: what brute force links is linked."""
    rnd, rows = random.Random(4), []
    base = [f"w{i}" for i in range(120)]
    for i in range(90):
        text = base.copy()
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            text[rnd.randrange(120)] = f"x{rnd.randrange(60)}"
        rows.append((i, " ".join(text)))
    want = kept_by_brute_force(rows)
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "_ROUNDS", rounds)
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want and 10 < len(want) < 80


def test_overlaps_and_forest(monkeypatch):
    monkeypatch.setattr(N, "_TOKENS", 7)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 40, r.integers(0, 30)).astype(np.int32)) for _ in range(25)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = N.overlaps(sets)
    off = ~np.eye(25, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()
    many = [np.arange(i // 5 * 100, i // 5 * 100 + 50, dtype=np.int32) for i in range(20)]
    assert len(N.forest(many, np.arange(20), None)) == 16
    assert len(N.forest(many, np.arange(20) // 5, None)) == 0
    assert len(N.forest(many, np.arange(20), np.arange(20) % 5 == 0)) == 16


def test_near_copies_of_nothing(spark):
    assert N.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_find_close_copies_without_bands(spark):
    """The search by SimHash links what lies within its radius; a set far from all others isn't linked."""
    from crestline.llm import simhash
    from crestline.llm.common import written

    rnd, rows = random.Random(3), [(99, "nothing like the others is said here")]
    for i in range(10):
        text = [f"w{rnd.randrange(10**6)}" for _ in range(600)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], "x"]))]
    fp = {i: simhash.majority(N.shingles(t.encode())) for i, t in rows}
    near = {(2 * i, 2 * i + 1) for i in range(10) if (fp[2 * i] ^ fp[2 * i + 1]).bit_count() <= N.BITS}
    found = written(N.sketches(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "row", "node", "fp", "n", "CAST(array() AS array<bigint>) AS bands", "hashes"), "test-sketches")
    of = {r.node: r.doc_id for r in found.collect()}
    assert {tuple(sorted((of[r.a], of[r.b]))) for r in N.near_links(found).collect()} == near and len(near) > 5


def test_majority_is_the_fingerprint():
    from crestline.llm import simhash

    words = " ".join(f"w{i}" for i in range(300))
    for text in ("", "one", "a b c d e", "a b c d e f", words):
        assert simhash.majority(N.shingles(text.encode())) == simhash.fingerprint(text.encode(), N.WIDTH)
