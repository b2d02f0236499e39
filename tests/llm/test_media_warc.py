"""Round trips through archives."""

import base64
import gzip
import hashlib
import io
import zipfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crestline.llm import media, warc
from crestline.llm.common import filesystem, scratch

TEXTS = [(1, "plain text"), (2, ""), (3, None), (4, "é" * 100), (5, "long " * 100_000), (6, "plain text"), (None, "no name"), (6, "plain text"), (7, "a\0b\0"), (8, "x" * 64), (9, "x" * 65)]


def frame(spark, rows, names=("doc_id", "text", "member", "payload", "media")):
    return spark.createDataFrame([(i, t, "m", "p", "q") for i, t in rows], ", ".join(f"{n} {'long' if k == 0 else 'string'}" for k, n in enumerate(names)))


# ------------------------------------------------------------------ media


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_png_round_trip(data):
    made = media.encode_png(data)
    samples, n = media.decode_png(made)
    payload = samples.tobytes()
    assert n == len(data) and payload[:n] == data and not payload[n:].strip(b"\0") and len(payload) == max(64, -(-len(data) // 64) * 64)
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(made[:60] + bytes([made[60] ^ 1]) + made[61:])


@pytest.mark.parametrize("options", [{}, {"range_bytes": 500, "batch_bytes": 100}])
def test_media_columns(spark, options):
    rows = media.media_columns(frame(spark, TEXTS), **options).collect()
    want = Counter()
    for i, t in TEXTS:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.payload_sha256, r.n_bytes].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_features_are_those_of_the_samples():
    samples, _ = media.decode_png(media.encode_png(bytes(range(256)) * 2))
    assert media.features(samples).startswith("64x8;mean=127.5000;std=73.9003;entropy=8.0000;ahash=")


def test_small_archives_ranges_and_leftovers(spark):
    folder = scratch(spark, "t")
    rows = spark.createDataFrame([(str(i), bytes([i]) * 500) for i in range(60)], "member string, payload binary").repartition(2)
    media.write_archives(rows, folder, archive_bytes=1000)
    fs, root = filesystem(folder)
    Path(root, "attempt-that-failed.zip").write_bytes(b"half an archive")  # not in the manifest
    got = media.read_archives(spark, folder, range_bytes=300, batch_bytes=1)
    assert got.rdd.getNumPartitions() > 10
    assert sorted(int(r.member) for r in got.collect()) == list(range(60))
    names = {p.name for p in Path(root).glob("*.zip")}
    assert len(names) > 5


def test_members_are_read_again_by_offset(tmp_path, monkeypatch):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("1", b"one")
        z.writestr("2", b"two")
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "tries": "3"})
    real, calls = media.read_member, Counter()

    def flaky(file, m):
        calls[m.filename] += 1
        if m.filename == "2" and calls["2"] < 3:
            raise OSError("lost")
        return real(file, m)

    monkeypatch.setattr(media, "read_member", flaky)
    (part,) = reader.partitions()
    got = [x for b in reader.read(part) for x in zip(b["member"].to_pylist(), b["media"].to_pylist())]
    assert got == [("1", b"one"), ("2", b"two")] and calls == {"1": 1, "2": 3}
    data = bytearray(path.read_bytes())
    data[data.index(b"two")] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(reader.read(part))


def test_partitions_are_bounded_and_share_small_archives(tmp_path, monkeypatch):
    for k in range(30):
        with zipfile.ZipFile(tmp_path / f"{k:02d}.zip", "w") as z:
            for i in range(5):
                z.writestr(str(5 * k + i), bytes(200))
    plan = lambda **options: media.ArchiveReader({"path": f"file://{tmp_path}", **options}).partitions()
    assert len(plan()) == 1 and len(plan()[0].ranges) == 30
    assert len(plan(range_bytes="500")) > 30 >= len(plan(range_bytes="500", max_partitions="25"))
    opened = Counter()
    real = media.filesystem

    class Spy:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            opened[path] += 1
            return self.fs.open_input_file(path)

    for options in ({}, {"range_bytes": "500"}, {"range_bytes": "500", "max_partitions": "25"}):
        reader = media.ArchiveReader({"path": f"file://{tmp_path}", **options})
        parts = reader.partitions()
        opened.clear()
        monkeypatch.setattr(media, "filesystem", lambda uri: (Spy(real(uri)[0]), real(uri)[1]))
        names = [m for part in parts for b in reader.read(part) for m in b["member"].to_pylist()]
        monkeypatch.undo()
        assert sorted(map(int, names)) == list(range(150))
        assert sum(opened.values()) == sum(len(part.ranges) for part in parts)  # one stream for a range


def test_media_of_nothing(spark):
    assert media.media_columns(frame(spark, TEXTS).where("false")).collect() == []


# ------------------------------------------------------------------ WARC


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é</p>"), (3, None, "<p>one</p>"), (4, "http://a/4\r\nX: y", ""), (5, "http://a/5", None), (None, "u", "<p>one</p>"), (None, "v", "alone"), (None, "w", "alone"), (3, "again", "<p>one</p>"), (8, "big", "\r\n\r\nWARC/1.1 " * 200_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int")


@pytest.mark.parametrize("least", [0, 1, 11])
def test_warc_round_trip(spark, least):
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(i)
    want = []
    for i, _, h in PAGES:
        payload = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        refers = top if len(payload) >= least and top is not None and i != top else None
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if refers is None else "revisit", refers))
    got = [tuple(r) for r in warc.warc_round_trip(pages(spark), least=least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_normalised_archives(spark):
    folder = scratch(spark, "w")
    raw = warc.write_monolithic(warc.with_revisits(pages(spark)), f"{folder}/raw", archive_bytes=50)
    clean = warc.normalise(raw, f"{folder}/clean")
    import json

    assert {r.archive for r in raw.collect()}.isdisjoint(r.archive for r in clean.collect())
    olds = sorted(gzip.decompress(Path(r.archive).read_bytes()) for r in raw.collect())
    news = []
    for r in clean.collect():
        data, index = Path(r.archive).read_bytes(), [json.loads(x) for x in Path(r.archive + ".idx").read_text().splitlines()]
        assert len(index) == r.records
        members = [gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index]
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
        assert sum(x["length"] for x in index) == len(data)
        news.append(b"".join(members))
    assert sorted(news) == olds


def test_streams_of_several_members_and_small_blocks():
    records = [warc.record(i, f"http://{i}", b"x" * i, None, "1970-01-01T00:00:00Z") for i in (0, 5, 5000)]
    data = b"".join(gzip.compress(r) for r in records)
    for size in (1, 7, 1 << 20):
        assert list(warc.split_records(warc.inflated(io.BytesIO(data), size))) == records
    with pytest.raises(ValueError, match="within a record"):
        list(warc.split_records(iter([records[2][:-1]])))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.split_records(iter([b"HTTP/1.1 200 OK\r\n\r\n"])))


def test_warc_of_nothing(spark):
    assert warc.warc_round_trip(pages(spark).where("false")).collect() == []


def test_damage_is_noticed(spark):
    data = warc.record(1, "u", b"payload", None, "d").replace(b"payload\r\n", b"paylaod\r\n")
    with pytest.raises(ValueError, match="damaged"):
        warc._row(data)


def test_hot_payload_counts(spark):
    hot = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("html"))
    got = {r.record_type: r["count"] for r in warc.warc_round_trip(hot).groupBy("record_type").count().collect()}
    assert got == {"response": 667, "revisit": 333}


def test_hot_payload_uses_a_split_join(spark):
    """A third of the pages share a payload; its partition is split over tasks, as the final plan says."""
    import random

    r = random.Random(1)
    hot = "".join(r.choices("0123456789abcdef", k=60_000))
    few = spark.range(900).repartition(12).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, hot).otherwise(F.col("id").cast("string")).alias("html"))
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        found = warc.with_revisits(few).select("page_id", "refers_to", F.length("payload"))
        got = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    assert {r.page_id: r.refers_to for r in got} == {i: 897 if i % 3 == 0 and i != 897 else None for i in range(900)}
    assert "skew=true" in plan


def test_cut_archives_are_refused(spark, tmp_path):
    """A stream flushed after each record and cut at a flush has whole records only, but isn't whole."""
    record = lambda i: warc.record(i, f"http://a/{i}", b"payload " * i, None, "1970-01-01T00:00:00Z")
    engine, parts = zlib.compressobj(1, zlib.DEFLATED, 31), []
    for i in range(1, 6):
        parts.append(engine.compress(record(i)) + engine.flush(zlib.Z_FULL_FLUSH))
    whole = b"".join(parts) + engine.flush()

    def normalised(data, records):
        path = tmp_path / f"{len(data)}-{records}.warc.gz"
        path.write_bytes(data)
        manifest = spark.createDataFrame([(str(path), records)], "archive string, records long")
        return warc.read_back(warc.normalise(manifest, str(tmp_path / f"out-{path.name}"))).count()

    assert normalised(whole, 5) == 5
    for data, records, said in ((b"".join(parts[:3]), 5, "within a gzip member"), (b"".join(parts[:3]), 3, "within a gzip member"), (whole, 6, "5 records, 6 were written"), (whole[:-40], 5, "ends within"), (gzip.compress(record(1)) + gzip.compress(record(2))[:-1], 2, "within a gzip member")):
        with pytest.raises(Exception, match=said):
            normalised(data, records)


def test_a_short_index_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(4)], "page_id long, url string, html string")
    members = warc.normalise(warc.write_monolithic(warc.with_revisits(rows.coalesce(1)), str(tmp_path / "raw")), str(tmp_path / "clean"))
    index = next((tmp_path / "clean").glob("*.idx"))
    index.write_bytes(b"".join(index.read_bytes().splitlines(True)[:-1]))
    with pytest.raises(Exception, match="3 records, 4 were written"):
        warc.read_back(members).count()
