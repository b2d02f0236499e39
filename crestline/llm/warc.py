"""WARC archives: writing with revisits, normalising monolithic gzip, reading by offset.

``write_monolithic`` writes each task's records as one gzip stream, as careless
crawlers do. ``normalise`` inflates such a file once, as a stream, rewrites every
record as a gzip member of its own, and writes a sidecar index with a record's
offset and length on each line. ``read_back`` fetches records by those offsets.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page_id is the response and the others revisit it.

Cases: a null payload is empty; a null url has no target header, and line breaks
in a url are percent-encoded; rows with a null identifier never are the response
of a group that has one, and are responses in a group that has none; rows that
repeat the largest identifier with an equal payload all are responses; an empty
table writes no archive and gives an empty result; other columns may have any names.
An archive that ends within a gzip member or a record, or whose records or index lines
aren't as many as were written, is refused with an error.
Normalised archives stay in the shared folder, since results read them;
``common.clear_scratch`` deletes them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import delete, filesystem, fresh, scratch, text_or_empty, tidy

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_BLOCK = 1 << 20
_MANIFEST = "archive string, records long"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: the response's identifier for revisits, else null.

    Groups are found by SHA-256 and length (equal SHA-1 digests can be made of
    different payloads) with partial maxima, and only keys with several rows are
    joined back, so pages without copies need not move if those are few. The join
    deals rows out anew, and Spark can split a payload that many pages have.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).cast("binary").alias("payload"))
    key = F.concat(F.unhex(F.sha2("payload", 256)), F.length("payload").cast("string").cast("binary"))
    groups = rows.where(F.length("payload") >= least).groupBy(key.alias("key")).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select(fresh("key").alias("key"), "response")
    found = rows.withColumn("of", key).join(groups, F.col("of") == F.col("key"), "left")
    revisits = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return found.select("page_id", "url", "payload", F.when(revisits, F.col("response")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 response, or a revisit that keeps the headers only."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, holding one at a time."""
    held, need = bytearray(), None
    for block in blocks:
        held += block
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the stream ends within a record")


def inflated(file, size: int = _BLOCK) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in blocks of bounded size; one that ends within a member is refused."""
    engine, begun = zlib.decompressobj(31), False
    while data := file.read(size):
        while data:
            begun = True
            if out := engine.decompress(data, size):
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the stream ends within a gzip member")


def _manifest(done: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["archive", "records"])


def write_monolithic(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows; returns the written manifest of archives.

    File names are unique to an attempt and count only once they are in the
    manifest, so a lost task's files are never read.
    """

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, out = [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = fs.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(*row, date)
                out.write(engine.compress(data))
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    out.write(engine.flush())
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            done.append((name, records))
        yield _manifest(done)

    return _kept(rows.mapInArrow(tidy(run), _MANIFEST), f"{folder}-manifest")


def _kept(manifest: DataFrame, path: str) -> DataFrame:
    """The manifest, written; a row of it stands for a whole archive, so it is dealt out evenly again."""
    manifest.write.parquet(path)
    spark = manifest.sparkSession
    found = spark.read.schema(_MANIFEST).parquet(path)
    return found.repartition(max(1, min(found.count(), 10_000)), F.xxhash64("archive"))


def normalise(manifest: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrite each archive with a member per record, and its sidecar ``.idx``; returns the new manifest."""

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for old, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, at, lines = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, []
                with fs.open_input_stream(old, compression=None) as source, fs.open_output_stream(name, compression=None) as out, fs.open_output_stream(f"{name}.idx") as index:
                    for data in split_records(inflated(source)):
                        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        head = parse_head(data[: data.index(b"\r\n\r\n")])
                        index.write(json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}).encode() + b"\n")
                        out.write(member)
                        at += len(member)
                        lines.append(at)
                if len(lines) != records:
                    raise ValueError(f"{old} has {len(lines)} records, {records} were written")
                done.append((name, len(lines)))
            yield _manifest(done)

    return _kept(manifest.mapInArrow(tidy(run), _MANIFEST), f"{folder}-manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """Every record of the archives, by the offsets of their indexes, with digests taken anew."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def batch_of(rows) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    def run(batches):
        rows = []
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(name)
                with fs.open_input_file(path) as file, fs.open_input_stream(f"{path}.idx") as index:
                    lines = index.read().splitlines()
                    if len(lines) != records:
                        raise ValueError(f"the index of {name} has {len(lines)} records, {records} were written")
                    for line in lines:
                        entry = json.loads(line)
                        file.seek(entry["offset"])
                        rows.append(_row(zlib.decompress(file.read(entry["length"]), 31)))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    return manifest.mapInArrow(tidy(run), schema)


def _row(data: bytes) -> tuple:
    end = data.index(b"\r\n\r\n")
    head = parse_head(data[:end])
    named = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        return _page_of(head["warc-record-id"]), int(head["x-payload-length"]), named, "revisit", _page_of(head["warc-refers-to"])
    block = data[end + 4 : -4]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest = payload_digest(payload)
    if digest != named:
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    return _page_of(head["warc-record-id"]), len(payload), digest, "response", None


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write the pages' archives, normalise them, and read every record back."""
    spark: SparkSession = pages.sparkSession
    raw, clean = scratch(spark, "warc-raw"), scratch(spark, "warc")
    monolithic = write_monolithic(with_revisits(pages, id_col, url_col, html_col, least), raw)
    members = normalise(monolithic, clean)
    delete(spark, raw)  # the normalised archives are complete and listed; without rows there is no such folder
    delete(spark, f"{raw}-manifest")
    return read_back(members)


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS response FROM p
), r AS (
  SELECT *, response IS NOT NULL AND page_id IS DISTINCT FROM response AS revisits FROM d
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (i * 5 // 4 + 1)::INTEGER, 2))::INTEGER >> (3 - i * 5 % 4)::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisits THEN response END AS refers_to
FROM r
"""
