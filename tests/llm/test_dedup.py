"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from crestline.llm import exact_dedup, near_text, simhash, substring_dedup
from crestline.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept string, digest string, fp string"


def docs(spark, rows):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


TEXTS = ["", " ", "a", "a b", "a  b", "a\tb ", "a b c d", "A b c d", "é ü", None, "x " * 30_000, "x " * 30_000 + "y", "a b c d e f g h"]


def mixed(seed, n=120):
    r = random.Random(seed)
    return [(None if r.random() < 0.05 else r.randrange(200), r.choice(TEXTS)) for _ in range(n)]


def plain(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# ------------------------------------------------------------------ exact


@pytest.mark.parametrize("bounds", [{}, {"combine_bytes": 1, "trie_bytes": 1}, {"combine_bytes": 1 << 20, "trie_bytes": 20_000}])
def test_exact_dedup(spark, bounds):
    rows = mixed(1)
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    first = set()
    stays = lambda i, t: i == least[plain(t)] and plain(t) not in first and not first.add(plain(t))
    want = sorted(((i, least[plain(t)], len(groups[plain(t)]), stays(i, t)) for i, t in rows), key=str)
    got = exact_dedup.exact_dedup(docs(spark, rows), **bounds).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == want
    kept = exact_dedup.keep_first(docs(spark, rows), **bounds)
    assert kept.columns == ["doc_id", "text", "kept", "digest", "fp"]
    stay = kept.collect()
    assert sorted(((r.doc_id, plain(r.text)) for r in stay), key=str) == sorted(((i, t) for t, i in least.items()), key=str)
    assert {(r.doc_id, r.text) for r in stay} <= set(rows)


def test_tied_rows_leave_one(spark):
    """Rows with one identifier and equal texts, of which the other columns differ or don't."""
    rows = [(1, "t", "b", "x"), (1, "t", "a", "x"), (1, "t", "a", "x"), (2, "t", "c", "x"), (None, "u", "d", "x"), (None, "u", "d", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string, __keep string")
    once = exact_dedup.keep_first(frame).collect()
    assert sorted(((r.doc_id, r.text) for r in once), key=str) == [(1, "t"), (None, "u")]
    assert sorted(map(str, once)) == sorted(map(str, exact_dedup.keep_first(frame.repartition(3)).collect()))
    decided = exact_dedup.exact_dedup(frame).collect()
    assert sorted(((r.doc_id, r.kept, r.group_size) for r in decided), key=str) == [(1, False, 4), (1, False, 4), (1, True, 4), (2, False, 4), (None, False, 2), (None, True, 2)]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs(spark, [(1, "a")]).where("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 99))), max_size=60), st.sampled_from([1, 500, 3000, 1 << 30]))
def test_tries_fold_like_a_dictionary(tmp_path_factory, rows, most):
    folder = f"file://{tmp_path_factory.mktemp('spill')}"
    want = defaultdict(list)
    for k, i in rows:
        want[k].append(i)
    got = list(exact_dedup.owners_of(((k, i, 1, 1) for k, i in rows), most, folder))
    assert len(got) == len(want)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in want.items()}
    assert {k: value for k, *value in got} == {k: [least[k], v.count(least[k]), len(v)] for k, v in want.items()}
    from pathlib import Path

    assert not list(Path(folder[7:]).iterdir())


# ------------------------------------------------------------------ near


def slow_fingerprint(text, width=3):
    """By the definition, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in plain(low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB cé\t\n\x0b ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(str(i * 7 % 1000) for i in range(70_000))
    words = text.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if int((h >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(h))
    assert simhash.fingerprint(text.encode()) == want


def near_rows(seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("red green blue old new big small cat dog house tree".split()) for _ in range(300)) for _ in range(6)]
    rows = [(i, None if i % 17 == 3 else "" if i % 19 == 5 else r.choice(base)) for i in range(60)]
    out = []
    for i, t in rows:
        if t and r.random() < 0.7:
            w = t.split()
            w[r.randrange(len(w))] = f"new{r.randrange(5)}"
            t = " ".join(w)
        out.append((i, t))
    return [*out, out[0], (None, "only this"), (None, "")]


def test_near_components(spark):
    rows = near_rows(3)
    of = {t: slow_fingerprint(t) for _, t in rows}
    roots = components(set(of.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for i, t in rows:
        least[roots[of[t]]].append(i)
    want = sorted(((i, f"{of[t]:016x}", min((x for x in least[roots[of[t]]] if x is not None), default=None)) for i, t in rows), key=str)
    got = simhash.simhash_near_dedup(docs(spark, rows))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some distinct fingerprints are linked
    stay = [r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()]
    twice = rows[-3]  # repeats a row as a whole
    assert sorted(stay, key=str) == sorted([*{w[2] for w in want}, *([twice[0]] if stay.count(twice[0]) > 1 else [])], key=str)


@pytest.mark.parametrize("keep_one", [simhash.keep_one, near_text.keep_one])
def test_rows_that_share_an_identifier(spark, keep_one):
    """Row 5 whose text is near row 1's goes though another row 5 stays; columns have names used inside."""
    a, b = (" ".join(f"{x}{i}" for i in range(300)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (None, "only")]
    frame = spark.createDataFrame([(i, t, 0, "x", "y", True) for i, t in rows], "doc_id long, text string, gone_id int, row string, component_id string, stays boolean")
    got = keep_one(frame)
    assert got.columns == frame.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (5, b), (None, "only")], key=str)


@pytest.mark.parametrize(("bits", "distance", "sizes"), [(64, 2, None), (20, 2, [3, 3, 2]), (12, 1, [4, 4]), (14, 3, None), (10, 0, None)])
def test_links_are_those_of_brute_force(spark, monkeypatch, bits, distance, sizes):
    """Fingerprints that share most bits, so that partitions have crowded values."""
    if sizes:
        starts = np.cumsum([0, *sizes])
        monkeypatch.setattr(simhash, "partitions_for", lambda n: [list(range(a, a + s)) for a, s in zip(starts, sizes)])
    r = random.Random(bits)
    centres = [r.getrandbits(64) for _ in range(4)]
    values = {r.choice(centres) ^ sum({1 << r.randrange(bits) for _ in range(r.randrange(4))}) for _ in range(300)} | {0, 1 << 63, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(a, b) for a, b in simhash.near_links(fps, distance).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance}
    assert got == want


def test_thresholds_meet_the_general_pigeonhole_bound():
    r = np.random.default_rng(1)
    near = r.dirichlet(np.ones(9), (50, 8))[:, :, :3]
    for parts in (simhash.partitions_for(10), simhash.partitions_for(1 << 22), simhash.partitions_for(1 << 31)):
        t = simhash.allocate(near, 1e6, parts, 2)
        assert ((t + 1).sum(axis=1) == 3).all() and t.min() >= -1


def test_near_dedup_of_nothing(spark):
    assert simhash.simhash_near_dedup(docs(spark, [(1, "a")]).where("false")).collect() == []


def test_components_of_chains_and_stars(spark):
    r = random.Random(5)
    names = r.sample(range(-1000, 1000), 120)
    links = [(names[i], names[i + 1]) for i in range(40)] + [(names[60], names[i]) for i in range(61, 100)] + [(names[110], names[110]), (names[101], names[102])]
    got = {n: x for n, x in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {x for pair in links for x in pair}
    pairs = {frozenset(p) for p in links}
    want = components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {n: x for n, x in want.items() if n != x}


# ------------------------------------------------------------------ substrings


def scanned(text):
    """(unit, line, start, stop, words, key) by a walk over characters, apart from the library's pattern."""
    out, begin, line = [], 0, 0
    while begin < len(text):
        end = begin + 1
        while end < len(text) and text[end] != "\n" and not (text[end] in ".!?" and text[end + 1 : end + 2] in [*" \t\n\x0b\x0c\r"]):
            end += 1
        end = min(len(text), end + (2 if text[end : end + 1] in [*".!?"] else 1))
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text[begin:end]).encode().split()
        if words:
            out.append((len(out), line, begin, end, len(words), b" ".join(words)))
        line += text[end - 1] == "\n"
        begin = end
    return out


def slow_repeats(rows, least=20):
    """(doc_id, text) -> (unit, start, stop, words, owner) of its repeated units that go, row by row in the order of ranks."""
    number = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    order = sorted(set((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, number(x[1])))
    seen, out = {}, {}
    for i, t in order:
        repeats, found = {}, scanned(t)
        for u in found:
            if u[5] in seen:
                repeats[u[0]] = (u[0], *u[2:5], seen[u[5]])
            else:
                seen[u[5]] = i
        gone, run = set(), []
        for unit in range(len(found) + 1):
            if unit in repeats:
                run.append(unit)
                continue
            if sum(repeats[x][3] for x in run) >= least:
                gone.update(run)
            run = []
        for line in {u[1] for u in found}:
            whole = [u[0] for u in found if u[1] == line]
            if all(x in repeats for x in whole):
                gone.update(whole)
        out[i, t] = [repeats[x] for x in sorted(gone)]
    return out


def test_units(spark):
    rng = random.Random(8)
    for _ in range(2_000):
        text = "".join(rng.choice([*"aB é\n\n.!?\t\r", ". ", " b"]) for _ in range(rng.randrange(14)))
        assert substring_dedup.units_of(text) == scanned(text), repr(text)


def test_whole_lines_go_at_any_length(spark):
    """A line of one word that recurs goes; a repeated sentence of few words within another line stays."""
    rows = [(1, "Yes.\nOnce more. And this.\n"), (2, "yes.\nOnce more. But not this.\n"), (3, "Once more. And this.\nyes. "), (4, "new"), (5, None)]
    got = {r.doc_id: (r.text, r.removed_words) for r in substring_dedup.deduplicated(docs(spark, rows), min_run_words=20).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Once more. But not this.\n", 1), 3: ("", 5), 4: ("new", 0), 5: (None, 0)}


def passages(seed):
    r = random.Random(seed)
    sentence = lambda k: " ".join(f"w{r.randrange(k)}" for _ in range(r.randrange(1, 30))).capitalize() + r.choice([". ", "! ", ".\n", "\n"])
    shared = ["".join(sentence(500) for _ in range(5)) for _ in range(4)]
    rows = []
    for i in range(30):
        text = "".join(sentence(500) for _ in range(4))
        if r.random() < 0.6:
            at = r.randrange(len(text))
            text = text[:at] + " " + r.choice(shared) + text[at:]
        rows.append((i, text))
    return [*rows, (40, None), (41, ""), (42, " \n \n"), (None, rows[0][1]), rows[1], (50, "é ü. " * 40), (51, "É ü. é  ü. " * 20)]


@pytest.mark.parametrize("least", [1, 20])
def test_repeated_units(spark, least):
    rows = passages(2)
    got = substring_dedup.repeated_units(docs(spark, rows), min_run_words=least)
    want = [(i, u[0], u[3], u[4]) for (i, _), gone in slow_repeats(rows, least).items() for u in gone]
    assert sorted(((r.doc_id, r.unit, r.words, r.owner_id) for r in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("least", [1, 20])
def test_cut_texts_keep_the_rest(spark, least):
    rows = passages(3)
    frame = docs(spark, rows).withColumnRenamed("digest", "removed")
    gone = slow_repeats(rows, least)

    def rest(i, t):
        return "".join(c for k, c in enumerate(t or "") if not any(a <= k < b for _, a, b, *_ in gone[i, t or ""]))

    cut = substring_dedup.without_units(frame, substring_dedup.repeated_units(frame, min_run_words=least)).collect()
    want = [(i, t if t is None else rest(i, t), [(a, b) for _, a, b, *_ in gone[i, t or ""]]) for i, t in rows]
    assert sorted(((r.doc_id, r.text, [(s.start, s.stop) for s in r._removed or []]) for r in cut), key=str) == sorted(want, key=str)
    found = substring_dedup.deduplicated(frame, min_run_words=least).collect()
    want = [(i, rest(i, t), " ".join(f"{a}-{b}:{'' if o is None else o}" for _, a, b, _, o in gone[i, t]), sum(u[3] for u in gone[i, t])) for i, t in rows if t is not None]
    assert sorted((tuple(r) for r in found if r.text is not None), key=str) == sorted(want, key=str)


def test_rows_of_one_identifier_lose_only_their_own_repeats(spark):
    """Of two rows with one identifier one repeats another document; the other's text is found nowhere else."""
    rows = [(1, "shared line of words\n"), (2, "shared line of words\n"), (2, "found nowhere else\n"), (None, "null one\n"), (None, "null two\nnull one\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.without_units(frame, substring_dedup.repeated_units(frame)).collect()
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    assert texts[:3] == [(1, "shared line of words\n"), (2, ""), (2, "found nowhere else\n")]
    assert sorted(t for i, t in texts if i is None) in (["", "null two\nnull one\n"], ["null one\n", "null two\n"])


def test_all_repeated_words_of_whole_units_go(spark):
    """By default nothing that repeats as a unit stays: each distinct unit is left once."""
    rows = passages(5)
    frame = docs(spark, rows)
    cut = substring_dedup.without_units(frame, substring_dedup.repeated_units(frame)).select("doc_id", "text").distinct().collect()
    left = [u[5] for r in cut for u in scanned(r.text or "")]
    every = {u[5] for _, t in rows for u in scanned(t or "")}
    assert sorted(left) == sorted(every)


def test_repeats_of_nothing(spark):
    assert substring_dedup.repeated_units(docs(spark, [(1, "a")]).where("false")).collect() == []
