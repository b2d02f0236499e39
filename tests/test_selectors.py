"""Selectors against a plain reading of the same alternatives, and texts that are none."""

import random

import pytest

from crestline.sources.selectors import read_selector, select_formats

COLUMNS = "entry string, format_id string, height int, bitrate double, has_video boolean, has_audio boolean, codec string"


def formats(seed, n=300):
    r = random.Random(seed)
    flag = lambda: r.choice([True, True, False, None])
    return [
        (r.choice([None, *map(str, range(40))]), r.choice([None, *(f"f{i}" for i in range(60))]), r.choice([None, 360, 720, 1080]), r.choice([None, 1.0, 2.5]), flag(), flag(), r.choice([None, "avc1", "av01", "vp9"]))
        for _ in range(n)
    ]


def plain(rows, kind, passes, worst=False):
    """The id that one part chooses, by three-valued logic spelt out."""
    def has(video, audio):
        either = True if True in (video, audio) else None if None in (video, audio) else False
        both = False if False in (video, audio) else None if None in (video, audio) else True
        return {"b": both, "b*": either, "bv*": video, "ba*": audio, "bv": video is True and audio is False, "ba": audio is True and video is False}[kind]

    sign = 1 if worst else -1
    left = [(sign * (h or 0), sign * (b or 0.0), i) for _, i, h, b, v, a, c in rows if i is not None and has(v, a) and passes(h, b, c)]
    return min(left)[2] if left else None


ANY = lambda h, b, c: True
CASES = {
    "bv*[height<=720]+ba/b[height<=720]/b": [
        [("bv*", lambda h, b, c: h is not None and h <= 720, False), ("ba", ANY, False)],
        [("b", lambda h, b, c: h is not None and h <= 720, False)],
        [("b", ANY, False)],
    ],
    " wv*[codec^=av][height>360] + ba*[bitrate >= ? 2] / w*": [
        [("bv*", lambda h, b, c: c is not None and c.startswith("av") and h is not None and h > 360, True), ("ba*", lambda h, b, c: b is None or b >= 2, False)],
        [("b*", ANY, True)],
    ],
    "bv[codec!=?vp9][codec$=?1]/ba[codec*=v][height=1080]/b*[bitrate<2.5][height!=360]": [
        [("bv", lambda h, b, c: c is None or c != "vp9" and c.endswith("1"), False)],
        [("ba", lambda h, b, c: c is not None and "v" in c and h == 1080, False)],
        [("b*", lambda h, b, c: b is not None and b < 2.5 and h is not None and h != 360, False)],
    ],
}


@pytest.mark.parametrize("selector", CASES)
@pytest.mark.parametrize("seed", [1, 2])
def test_choices(spark, selector, seed):
    rows = formats(seed)
    want = {}
    for entry in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == entry]
        tried = [[plain(mine, *part) for part in parts] for parts in CASES[selector]]
        want[entry] = next(((i, ids) for i, ids in enumerate(tried, 1) if None not in ids), (None, None))
    got = select_formats(spark.createDataFrame(rows, COLUMNS).repartition(3), selector).collect()
    assert {r.entry: (r.alternative, r.format_ids) for r in got} == want and len(got) == len(want)
    assert {i for i, _ in want.values()} >= {1, 2}


def test_a_separator_within_brackets(spark):
    """A value may hold what separates names outside of brackets."""
    assert [len(parts) for parts in read_selector("b[codec=a/b+c]+ba/b")] == [2, 1]
    rows = [("e", "x", 1, 1.0, True, True, "a/b+c"), ("e", "y", 2, 1.0, True, True, "z")]
    found = select_formats(spark.createDataFrame(rows, COLUMNS), "b[codec=a/b+c]").collect()
    assert [(r.alternative, r.format_ids) for r in found] == [(1, ["x"])]
    assert select_formats(spark.createDataFrame([], COLUMNS), "b").collect() == []


@pytest.mark.parametrize("selector", ["", "b/", "+b", "best", "b[height]", "b[height<=]", "b[height<=720", "b]", "b[height<720]x", "b**", "b,ba", "(b/ba)+b"])
def test_texts_that_are_no_selectors(selector):
    with pytest.raises(ValueError):
        read_selector(selector)


@pytest.mark.parametrize("selector", ["b[width<=720]", "b[height^=7]", "b[height<tall]", "b[codec<avc]", "b[has_video=1]"])
def test_filters_that_fit_no_column_are_refused_with_the_plan(spark, selector):
    with pytest.raises(ValueError):
        select_formats(spark.createDataFrame([], COLUMNS), selector)
