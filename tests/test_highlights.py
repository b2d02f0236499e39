"""Cases of the blueprint's fixtures, properties, and the plans' shape."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crestline.functions import text as X
from crestline.operators import lines as L
from crestline.operators import series as S
from crestline.operators.peaks import best_candidates, select_peaks
from crestline.params import DetectParams, RunRequest
from crestline.plans import highlights as H
from crestline.sources import levels as V


def picked(spark, levels, k, duration, **more):
    """Peaks of one smoothed series, as (second, score)."""
    if not levels:
        return []
    p = DetectParams(k=k, duration=duration, **more)
    smoothed = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(levels)], "series_id string, second int, smoothed double")
    rows = select_peaks(S.candidates(S.scored(smoothed), p), p).orderBy("rank").collect()
    return [(r.second, round(r.score, 6)) for r in rows]


def seconds(*args, **more):
    return [s for s, _ in picked(*args, **more)]


def flat(n=300, base=-20.0, **at):
    out = [base] * n
    for k, v in at.items():
        out[int(k[1:])] = v
    return out


@pytest.mark.parametrize(
    ("levels", "k", "duration", "expected"),
    [
        (flat(_100=-3.0, _220=-5.0), 2, 30, [100, 220]),
        (flat(100), 6, 45, []),
        ([], 6, 45, []),
        ([0, 0, 10, 10], 2, 30, []),
        (flat(_100=-18.5), 2, 30, [100]),
        (flat(_100=-18.6), 2, 30, []),
        (flat(_100=-3.0, _160=-5.0), 2, 30, [100, 160]),
        (flat(_160=-3.0, _100=-5.0), 2, 30, [160]),
        (flat(_29=-3.0), 1, 30, []),
        (flat(_30=-3.0), 1, 30, [30]),
        (flat(_270=-3.0), 1, 30, []),
        (flat(_269=-3.0), 1, 30, [269]),
        (flat(9, _0=-3.0), 1, 30, [0]),
        (flat(_100=-3.0, _220=-3.0), 1, 30, [100]),
        (flat(_100=-3.0), 6, 30, [100]),
    ],
)
def test_peaks(spark, levels, k, duration, expected):
    assert seconds(spark, levels, k, duration) == expected


def greedy(levels, k, sep, least=1.5):
    """The literal loop: take the best, blank its surroundings, repeat."""
    n = len(levels)
    base = sorted(levels)[n // 2]
    margin = min(30, n // 10)
    left = {i: x - base for i, x in enumerate(levels) if margin <= i < n - margin}
    out = []
    while left and len(out) < k:
        best = min(left, key=lambda i: (-left[i], i))
        if left[best] < least:
            break
        out.append((best, round(left[best], 6)))
        left = {i: x for i, x in left.items() if not best - sep <= i < best + sep}
    return out


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.sampled_from([15, 30, 45]))
def test_peaks_are_those_of_the_loop(spark, seed, k, duration):
    r = random.Random(seed)
    levels = [float(r.choice([0, 0, 0, 1, 2, 5, 9, 9])) for _ in range(r.randrange(1, 400))]
    want = greedy(levels, k, duration + 30)
    assert picked(spark, levels, k, duration) == want
    assert all(a[1] >= b[1] for a, b in zip(want, want[1:]))
    starts = sorted(max(0, s - int(duration * 0.4)) for s, _ in want)
    assert all(b - a >= duration for a, b in zip(starts, starts[1:]))


def test_few_candidates_decide_a_long_series(spark):
    """A plateau of equal scores: what is gathered of a series doesn't grow with its length."""
    p = DetectParams(k=3, duration=15)
    levels = [float(i // 500 % 7) for i in range(9000)]
    found = S.candidates(S.scored(spark.createDataFrame([("a", i, x) for i, x in enumerate(levels)], "series_id string, second int, smoothed double")), p)
    assert found.count() >= 2000 and best_candidates(found, p).count() == p.most_candidates == 181
    assert [(r.second, r.score) for r in select_peaks(found, p).orderBy("rank").collect()] == greedy(levels, 3, 45)
    assert "WindowGroupLimit" in best_candidates(found, p)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0, 5.0, 5.0, 1.0], [float(i * 7919 % 101) for i in range(1000)], [-0.5, 0.5, 0.5, 9.0, 9.0, 9.0]])
def test_baseline_is_the_upper_median(spark, values):
    frame = spark.createDataFrame([("a", i, x) for i, x in enumerate(values)] + [("b", 0, 4.0)], "series_id string, second int, smoothed double")
    assert {r.series_id: (r.baseline, r.n) for r in S.baseline(frame).collect()} == {"a": (sorted(values)[len(values) // 2], len(values)), "b": (4.0, 1)}
    assert "percentile" not in S.baseline(frame)._jdf.queryExecution().toString().lower()


def test_a_wrong_time_costs_its_own_series_only(spark):
    """Times in the billions make no spine of billions: a gap is one run, and the series has its peaks like others."""
    good = [(i, -3.0 if i == 100 else -20.0) for i in range(300)]
    lines = [("good", f"t: {t} M: {x}") for t, x in good] + [("bad", f"t: {t} M: {x}") for t, x in good] + [("bad", "t: 99999999999 M: -3.0"), ("bad", "t: " + "9" * 400 + " M: -1"), ("worse", "t: 2000000000 M: -1")]
    samples = V.parse_lines(spark.createDataFrame(lines, "series_id string, line string"))
    p = DetectParams(k=1, duration=30, decimals=1)
    assert {r.series_id: r.status for r in H.statuses(samples, p).collect()} == {"good": "ok", "bad": "ok", "worse": "too_short"}
    assert {(r.series_id, r.second) for r in H.detect(samples, p).collect()} == {("good", 97), ("bad", 97)}
    assert {(r.series_id, r.status, r.clips) for r in H.completion(samples, p).collect()} == {("good", "ok", 1), ("bad", "ok", 1), ("worse", "too_short", 0)}


def test_a_bucket_at_ten_to_the_twelfth(spark):
    """The edges, the baseline and the peaks of a series whose gaps no spine could fill."""
    far = 10**12
    levels = [(i, -20.0) for i in range(40)] + [(far // 2 + i, -30.0 + i) for i in range(3)] + [(far, -1.0), (far + 200, -5.0)]
    runs = S.smooth_runs(raw(spark, levels).selectExpr("series_id", "CAST(t AS bigint) AS second", "level", f"CAST({far + 201} AS bigint) AS n"), DetectParams(decimals=1))
    assert runs.count() < 100 and runs.selectExpr("sum(last - first + 1)").first()[0] == far + 201
    p = DetectParams(k=3, duration=30, decimals=1, min_buckets=5)
    got = [(r.second, round(r.score, 4)) for r in H.detect(raw(spark, levels), p).orderBy("rank").collect()]
    assert got == [(30, 50.0), (far // 2 - 1 + 0, round(123 / 7, 4)), (far - 3, round(69 / 7, 4))]


@pytest.mark.parametrize("decimals, stretch", [(None, 100_000), (1, 100_000), (1, 7), (None, 13), (2, 1)])
def test_runs_equal_the_dense_series(spark, decimals, stretch):
    rng, rows = random.Random(decimals), []
    for series in "abcde":
        at = rng.choice([0, 0, 3, 50])
        for _ in range(rng.randrange(1, 60)):
            rows.append((series, at, rng.randrange(-700, 0) / 10))
            at += rng.choice([1, 1, 1, 2, 5, 6, 7, 8, 9, 40])
    buckets = spark.createDataFrame(rows, "series_id string, second bigint, level double")
    p = DetectParams(decimals=decimals, half_window=rng.choice([0, 1, 3, 5]), min_score=rng.choice([-1.0, 0.0, 1.5]))
    dense = S.smooth(S.densify(buckets, p), p)
    n = buckets.groupBy("series_id").agg((F.max("second") + 1).alias("n"))
    runs = S.smooth_runs(buckets.join(n, "series_id"), p, stretch)
    spread = runs.select("series_id", F.explode(F.sequence("first", "last")).alias("second"), "smoothed")
    rounded = lambda x: sorted((r.series_id, r.second, round(r.smoothed, 8)) for r in x.collect())
    assert rounded(spread) == rounded(dense)
    assert {(r.series_id, round(r.baseline, 8), r.n) for r in S.baseline(runs).collect()} == {(r.series_id, round(r.baseline, 8), r.n) for r in S.baseline(dense).collect()}
    if decimals:
        peaks = lambda x: sorted(map(tuple, select_peaks(S.candidates(S.scored(x), p), p).collect()))
        assert peaks(runs) == peaks(dense)


@pytest.mark.parametrize("bins", [2, 3, 40, 200])
def test_baseline_by_bins_and_weights(spark, bins):
    """Exact whatever the bins: random values with ties, negative zero, and runs that hold most of a series."""
    rng, rows, plain = random.Random(bins), [], {}
    for series in "abcdef":
        held = []
        for i in range(rng.randrange(1, 400)):
            value, many = rng.choice([rng.gauss(0, 10), float(rng.randrange(-3, 3)), 10 ** rng.uniform(-200, 200), -0.5]), rng.choice([1, 1, 1, 30])
            rows.append((series, i * 100, i * 100 + many - 1, value))
            held += [value] * many
        plain[series] = (sorted(held)[len(held) // 2], len(held))
    frame = spark.createDataFrame(rows, "series_id string, first bigint, last bigint, smoothed double")
    assert {r.series_id: (r.baseline, r.n) for r in S.baseline(frame, bins).collect()} == plain


def test_no_task_sorts_a_whole_series(spark):
    """Half a million values of one series: after the cut into bins, one bin is left to sort."""
    frame = spark.range(0, 500_000, 1, 8).selectExpr("'a' AS series_id", "id AS second", "CAST(pmod(hash(id), 1000000007) AS double) AS smoothed")
    found = S.baseline(frame)
    want = frame.orderBy("smoothed").select("smoothed").collect()[250_000][0]
    assert found.first().baseline == want


def raw(spark, levels, series="a"):
    return spark.createDataFrame([(series, float(t), float(x)) for t, x in levels], "series_id string, t double, level double")


def test_pipeline_reports_the_start_of_a_plateau(spark):
    rows = H.detect(raw(spark, [(i, -3.0 if i == 100 else -20.0) for i in range(300)]), DetectParams(k=1, duration=30, decimals=1)).collect()
    assert [(r.second, round(r.score, 4)) for r in rows] == [(97, 2.4286)]


def test_lines_become_samples(spark):
    lines = ["t: 1.5 M: -3.5 S: 1", "t: 2 M: nan", "t: 3 M:-inf", "t: 4 M: inf", "t: 5 M: 1.2.3", "t: 1.2.3 M: -1", "no level here", None, "", "[x] t: 7.25   TARGET M: -120.7"]
    got = V.parse_lines(spark.createDataFrame([("a", x) for x in lines], "series_id string, line string"))
    assert sorted((r.t, r.level) for r in got.collect()) == [(1.5, -3.5), (2.0, -70.0), (3.0, -70.0), (4.0, -70.0), (5.0, -70.0), (7.25, -120.7)]
    assert {r.level for r in S.bucket_max(got).where("second = 7").collect()} == {-70.0}


def test_buckets_gaps_and_guard(spark):
    p = DetectParams()
    got = S.bucket_max(raw(spark, [(5.9, -25), (5.1, -30), (7, -1), (3, -2)]), p)
    assert sorted((r.second, r.level) for r in got.collect()) == [(3, -2.0), (5, -25.0), (7, -1.0)]
    dense = S.densify(got, p)
    assert [r.level for r in dense.orderBy("second").collect()] == [-70, -70, -70, -2, -70, -25, -70, -1]
    two = S.observed(S.bucket_max(raw(spark, [(i * 100, -1) for i in range(30)]).unionByName(raw(spark, [(i, -1) for i in range(29)], "b")), p), p)
    assert {(r.series_id, r.observed, r.n, r.status) for r in two.collect()} == {("a", 30, 2901, "ok"), ("b", 29, 29, "too_short")}


def test_smoothing_is_cut_at_the_ends_and_the_same_in_stretches(spark):
    dense = spark.createDataFrame([("a", i, 7.0 * i) for i in range(50)], "series_id string, second int, level double")
    p = DetectParams(decimals=1)
    whole = {r.second: r.smoothed for r in S.smooth(dense, p).collect()}
    assert whole[0] == 10.5 and whole[10] == 70.0 and len(whole) == 50
    for stretch in (1, 2, 5, 49):
        assert {r.second: r.smoothed for r in S.smooth(dense, p, stretch).collect()} == whole
    assert {r.second: r.smoothed for r in S.smooth(dense, DetectParams()).collect()}[3] == 21.0


def test_statuses(spark):
    samples = raw(spark, [(i, -20) for i in range(40)]).unionByName(raw(spark, [(1, -2)], "short")).unionByName(raw(spark, [(i, -3 if i == 100 else -20) for i in range(300)], "loud"))
    assert {r.series_id: r.status for r in H.statuses(samples).collect()} == {"a": "no_peaks", "short": "too_short", "loud": "ok"}
    with pytest.raises(ValueError, match="without peaks"):
        H.statuses(samples, strict=True)


def test_empty_input(spark):
    none = raw(spark, [(1, 1)]).where("false")
    assert H.detect(none).collect() == [] and H.statuses(none).collect() == []


@pytest.mark.parametrize("bad", [{"k": 0}, {"duration": 14}, {"duration": 121}, {"bucket_seconds": 0}, {"lead": 2}])
def test_parameters_are_checked_first(bad):
    with pytest.raises(ValueError):
        DetectParams(**bad)


@pytest.mark.parametrize(("bad", "match"), [({"entry": ' "" '}, "entry"), ({"output": "\u00a0\u3000"}, "output"), ({"k": "six"}, "whole"), ({"duration": 1000}, "duration"), ({"k": 0}, "k must")])
def test_requests_are_checked_at_once(spark, bad, match):
    good = {"entry": ' "a b.mp4" ', "output": "out", "k": "6", "duration": 45}
    assert (RunRequest(**good).entry, RunRequest(**good).k) == ("a b.mp4", 6)
    with pytest.raises(ValueError, match=match):
        RunRequest(**good | bad)
    said = one(spark, X.request_status(*(F.lit(str(v)) for v in ({**good, **bad}[x] for x in ("entry", "output", "k", "duration")))))
    assert said == {"entry": "no_entry", "output": "no_output", "whole": "bad_number", "duration": "bad_range", "k must": "bad_range"}[match]


def test_saved_configuration(spark):
    import json

    values = ('a "quoted" é\\', "tab\t", "")
    text = one(spark, V.config_text(*map(F.lit, values)))
    assert text == json.dumps(dict(zip(("nombre", "logo", "salida"), values, strict=True)), ensure_ascii=False, indent=2)
    assert one(spark, V.config_text(F.lit(None).cast("string"), F.lit("x"), F.lit("y"))).startswith('{\n  "nombre": ""')


def test_format_choice(spark):
    rows = [
        ("pair", "v1", 720, 1.0, True, False), ("pair", "v2", 1080, 1.0, True, False), ("pair", "a", None, 1.0, False, True), ("pair", "c", 480, 9.0, True, True),
        ("fitting", "c1", 480, 1.0, True, True), ("fitting", "c2", 480, 2.0, True, True), ("fitting", "c3", 1080, 1.0, True, True),
        ("large", "c", 2160, 1.0, True, True), ("none", "a", None, 1.0, False, True),
    ]
    formats = spark.createDataFrame(rows, "entry string, format_id string, height int, bitrate double, has_video boolean, has_audio boolean")
    assert {r.entry: r[1:] for r in V.choose_formats(formats).collect()} == {"pair": ("video+audio", "v1", "a"), "fitting": ("fitting", "c2", None), "large": ("combined", "c", None), "none": ("none", None, None)}
    assert {r.entry: r.video_id for r in V.choose_formats(formats, hd=True).collect()} == {"pair": "v2", "fitting": "c3", "large": "c", "none": None}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_times_and_text(spark):
    assert one(spark, X.clock(F.lit(3723.9))) == "01:02:03" and one(spark, X.file_clock(F.lit(3723.9))) == "01-02-03"
    assert one(spark, X.clock(F.lit(360000))) == "100:00:00"
    assert one(spark, X.escape_text(F.lit("Canal: 50%, 'sí'"))) == "Canal\\: 50\\, sí"
    for text in (' \t"a b" \n', '\u00a0\u3000"a b"\u2028', '\x1c""a b""\x85'):
        assert one(spark, X.trimmed(F.lit(text))) == text.strip().strip('"') == "a b"
    assert one(spark, X.base_name(F.lit("/a/b.mp4"))) == "b.mp4"
    assert one(spark, X.is_remote(F.lit("HTTPS://x"))) and not one(spark, X.is_remote(F.lit("ftp://x")))
    assert one(spark, X.percent(F.lit("[download]  42.5% of"))) == 42.5 and one(spark, X.percent(F.lit("x"))) is None
    assert [one(spark, X.is_version(F.lit(v))) for v in ("1.0.0", "01.0.0", "1.0.0-rc", "1.0")] == [True, False, False, False]
    assert one(spark, L.last_or(F.array().cast("array<string>"), "none")) == "none"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 4000).map(lambda n: n / 20), st.floats(0, 1000)), min_size=20, max_size=60))
def test_tenths_round_like_c(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", X.tenths(F.col("v")).alias("x")).collect()
    assert [r.x for r in rows] == [f"{r.v:+.1f}" for r in rows]


def test_filters(spark):
    def graph(vertical, name, logo, font=""):
        return one(spark, H.render_filter(F.lit(vertical), F.lit(name), F.lit(logo), F.lit(font).cast("string"), "C:/x.ttf"))

    assert graph(False, "", False) == "[0:v]null[v];[v]null[out]"
    tall = graph(True, "Mi canal", True)
    assert "crop=1080:1920" in tall and "[1:v]scale=-1:110" in tall and "text='Mi canal'" in tall and tall.endswith("[out]") and "fontfile" not in tall
    assert "fontfile='C\\:/x.ttf':" in graph(False, "n", False, None)


def test_clips_and_reports(spark, tmp_path):
    peaks = spark.createDataFrame([("a", 1, 100, 2.25), ("a", 2, 10, 1.5)], "series_id string, rank int, second int, score double")
    plan = {r.rank: r for r in H.clip_plan(peaks, DetectParams()).collect()}
    assert (plan[1].clip_start, plan[1].file_name) == (82, "clip_01_min_00-01-22.mp4") and plan[2].clip_start == 0
    reports = H.report(H.summary(peaks))
    text = "Momentos detectados (mejor primero):\n\nclip_01: momento 00:01:40 del VOD (+2.2 dB sobre lo normal)\nclip_02: momento 00:00:10 del VOD (+1.5 dB sobre lo normal)\n"
    assert reports.first().text == text
    H.write_reports(reports, str(tmp_path / "r"))
    assert "".join(p.read_text() for p in (tmp_path / "r").rglob("part-*")) == text
    H.write_clip_plan(H.clip_plan(peaks), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_config(spark):
    rows = spark.createDataFrame([("{}",), ("no json",), ("[1]",), (None,), ('{"nombre": "n", "salida": "s"}',), ('{"salida": ""}',)], "j string")
    got = [(r.nombre, r.logo, r.salida) for r in V.parse_config(rows, "j", "out").collect()]
    assert got == [("", "", "out")] * 4 + [("n", "", "s"), ("", "", "out")]


def test_tail_and_throttle(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 5, 9, 10, 19, 20, 100, 50])], "k string, o long, v double")
    assert sorted(r.o for r in L.tail(rows, "k", "o", 3).collect()) == [5, 6, 7]
    assert [r.v for r in L.throttled(rows, "k", "o", "v").orderBy("o").collect()] == [0, 10, 20, 100]


def test_reading_lines(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "one.log").write_text(f"t: 1 M: -2\n{folder}\n")
        (tmp_path / folder / "two.txt").write_text("t: 1 M: -2\n")
    got = V.read_lines(spark, str(tmp_path / "*"), "*.log").collect()
    assert {(r.series_id.removeprefix("file:").replace("///", "/"), r.line) for r in got} == {(f"{tmp_path}/{x}/one.log", line) for x in "ab" for line in ("t: 1 M: -2", x)}


def test_late_lines_of_a_stream(spark, tmp_path):
    """Files of lines through parsing and buckets, appended to Parquet: a line behind the watermark is left out, others count."""
    from crestline.streaming.levels import bucket_stream, keep_buckets

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "rec.log").write_text("\n")  # so that the first batch has a file
    p = DetectParams(bucket_seconds=60)

    def lines():
        return V.stream_lines(spark, str(folder), "*.log", files_per_trigger=1)

    def run(text, name):
        (folder / name).write_text(text)
        one_series = V.at_origin(V.parse_lines(lines())).withColumn("series_id", F.lit("s"))
        out = bucket_stream(one_series, p, late="2 minutes").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        out.awaitTermination()

    run("t: 10 M: -9\nt: 70 M: -8\nnothing\n", "1.log")
    run("t: 20 M: -5\nt: 600 M: -7\n", "2.log")  # 20 is within two minutes of 70
    run("t: 30 M: -1\nt: 900 M: -3\n", "3.log")  # 30 is not of 600
    got = {r.second: r.level for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == -5.0 and got[1] == -8.0 and 15 not in got
    kept = keep_buckets(bucket_stream(V.at_origin(V.parse_lines(lines())).withColumn("series_id", F.lit("s")), p, late="1 day"), f"file://{tmp_path}/kept")
    assert {r.second: r.level for r in kept.collect()} == {0: -1.0, 1: -8.0, 10: -7.0, 15: -3.0}


def test_throttle_of_a_stream(spark, tmp_path):
    from crestline.streaming.levels import throttle_stream

    source = tmp_path / "in"
    schema = "k string, o long, v double"
    for i, part in enumerate([[("a", 0, 0.0), ("a", 1, 5.0)], [("a", 2, 9.0), ("a", 3, 10.0), ("b", 1, 50.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = throttle_stream(stream, "k", "o", "v").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    assert sorted((r.k, r.o, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 0, 0.0), ("a", 3, 10.0), ("b", 1, 50.0)]


def test_plans_prune_columns_and_avoid_python(spark):
    from crestline import queries as Q

    plan = Q.peaks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    reads = [x for x in plan.splitlines() if "ReadSchema" in x or "FileScan" in x]
    assert reads and not any("props" in x for x in reads)
