"""The filters' audit against a walk over documents, and against SQL."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from crestline.llm import filter_audit as A
from crestline.llm.registry import op12_filter_audit

SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels, least_words=200):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None and (t or "") not in first or i is not None and i < first[t or ""]:
            first[t or ""] = i
    failed = []
    for i, t, s in docs:
        text = t or ""
        words = text.encode().split()
        own = {"A": len(words) < least_words, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": text in first and (i is None or i > first[text])}
        failed.append((s or "", {k for k, v in own.items() if v}, i in good, i in toxic))
    out, shapley = defaultdict(Counter), Counter()
    for part, *_ in failed:
        for order in map("".join, itertools.permutations("ABCDE")):
            for k in range(1, 6):
                out[part, order, k]["kept"] += 0
    for part, bad, is_good, is_toxic in failed:
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order, 1):
                at = out[part, order, k]
                if f in bad:
                    at["redundant" if gone else "removed"] += 1
                    if not gone:
                        at["good_lost"] += is_good
                        at["toxic_lost"] += is_toxic
                        shapley[part, f] += 1
                    gone = True
                at["unique_fails"] += bad == {f}
                at["kept"] += not gone
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, o, k): (*(c[n] for n in names), shapley[p, o[k - 1]]) for (p, o, k), c in out.items()}


def results(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()}


@pytest.mark.parametrize("places", [1 << 16, 1 << 20])
def test_against_brute_force(spark, places):
    rng = random.Random(7)
    pool = ["", " \t\n", "one two", "a b c d e f", "A B C d e f", "x x x x x x", "cost $5 of it all", "é É über ñ", "AA|bb cc dd", "a\x0bb\x0cc", "w " * 9]
    docs = [(rng.choice([None, *range(60)]), rng.choice([*pool, None, f"rare {i} words here"]), rng.choice(["s", "t", None, ""])) for i in range(300)]
    docs += docs[:9]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(50), 3, 4, None]]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in docs], SCHEMA + ", part string, N int")
    got = results(A.filter_audit(frame, spark.createDataFrame(labels, LABELS), least_words=4, most_places=places))
    assert got == brute(docs, labels, least_words=4)


def test_sketch_clears_unique_texts_only(spark):
    texts = [f"text {i}".encode() for i in range(5_000)] + [b"twice", b"twice"] + [b"often"] * 900
    frame = spark.createDataFrame([(bytearray(x),) for x in texts], "text binary").repartition(7)
    bits = A.repeated_places(frame, 1 << 17)
    at = A._places(texts, 1 << 17)
    maybe = ((bits[at >> 3] >> (at & 7)) & 1).all(axis=1)
    assert maybe[5_000:].all()
    assert maybe[:5_000].mean() < 0.01


def test_empty_and_long(spark):
    labels = spark.createDataFrame([], LABELS)
    assert A.filter_audit(spark.createDataFrame([], SCHEMA), labels).collect() == []
    got = results(A.filter_audit(spark.createDataFrame([(1, "word " * 400_000, "s")], SCHEMA), labels))
    assert len(got) == 600 and got["s", "ABCDE", 1][:2] == (1, 0) and got["s", "ABCDE", 2][:2] == (0, 1)


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = db.execute(A.OP12_SQL).fetchall()
    got = op12_filter_audit(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(want)
