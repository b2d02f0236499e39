"""Collocations against brute force over phrases, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from crestline.llm import collocations as C
from crestline.llm.registry import op13_collocations

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top=2_000, percent=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        scores = {}
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scores[p] = (score, a, counts[p[:k]], counts[p[k:]])
        inside = {p[i : i + m] for p in scores for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * counts[p] >= percent * counts[p[i : i + m]]}
        ranked = sorted(((-s, -a, " ".join(p).encode(), l, r) for p, (s, a, l, r) in scores.items() if p not in inside))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(ranked[:top], 1)]
    return sorted(out)


def rows(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("least, top, percent", [(2, 2_000, 100), (3, 20, 100), (4, 2_000, 80), (9, 2_000, 100)])
def test_against_brute_force(spark, least, top, percent):
    rng = random.Random(least)
    words = ["the", "The", "of", "ein", "éa", "ÉA", "x y", "a-b", "q", "zz", "\x1f", "..", "no"]
    gaps = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "!? "]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(80))) for _ in range(120)]
    docs = [(i, rng.choice([t, t, None, "Fixed phrase of five words here. " * 3]), rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += docs[:11]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in docs], SCHEMA + ", phrase string, N int").repartition(5)
    assert rows(C.collocations(frame, least=least, top=top, percent=percent)) == brute(docs, least, top, percent)


def test_small_filters_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(60)), "en") for i in range(200)]
    monkeypatch.setattr(C, "_MOST_BITS", 64)  # so full that nearly all passes
    assert rows(C.collocations(spark.createDataFrame(docs, SCHEMA), least=5)) == brute(docs, 5)


def test_filter_holds_its_keys(spark):
    keys = [f"k{i}" for i in range(3_000)]
    frame = spark.createDataFrame([("en", k) for k in keys], "lang string, phrase string")
    made = C.bloom(frame.select(C._hash(frame.phrase).alias("h")))
    of = lambda names: C._hashes(C.Words(None, None, None, pa.array(["en"] * len(names)), pa.array(names, pa.large_string()), None))
    assert C._held(made, of(keys)).all()
    assert C._held(made, of([f"other{i}" for i in range(3_000)])).mean() < 0.02


def test_large_counts_are_exact(spark):
    big = 9 * 10**14
    phrases = spark.createDataFrame([("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 7)], "lang string, phrase string, n long")
    sizes = spark.createDataFrame([("en", big + 10**13)], "lang string, n long")
    got = C.scored(phrases, sizes).collect()[0]
    assert got.score == 1000 * big * (big + 10**13) // ((big + 1) * (big + 7))


def test_empty_long_and_single(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "one", "en"), (4, " . ,", "en")], SCHEMA)).collect() == []
    got = rows(C.collocations(spark.createDataFrame([(1, "ab cd " * 300_000, "en")], SCHEMA)))
    assert got and all(x[6] == 600_000 for x in got)


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        want = db.execute(C.OP13_SQL).fetchall()
    assert want and rows(op13_collocations(spark, folder)) == sorted(want)
