"""Media columns: payloads as 8-bit samples in archives, and a data source over those.

``write_archives`` encodes each payload as an 8-bit greyscale PNG, 64 samples a
row, and packs the images into ZIP archives of bounded size in one directory.
``ArchiveSource`` reads such a directory: the driver lists the archives and plans
partitions of byte ranges, of which there are ``max_partitions`` at most: small
archives share one, and beyond that number ranges grow. A task reads an archive's
directory, takes the members whose header starts in its range, and fetches each by
its own offset from one open stream; after a failed or damaged read it repeats that
member alone, on a stream opened anew. Payloads travel in Arrow batches of bounded
size. The driver holds a name and a size for each archive, so archives should be
larger the more there is to store (``archive_bytes``).

Cases: a null text is the empty one; an empty payload is 64 zero bytes; a null
identifier makes a nameless member and is null again when read; repeated rows
make a member each; long payloads may exceed an archive's or a batch's bound,
which then holds them alone; an empty table writes no archive and reads as an
empty result; other columns may have any names. Archives stay in the shared folder,
since results read them; ``common.clear_scratch`` deletes them.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from crestline.llm.common import filesystem, scratch, text_or_empty, tidy

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SCHEMA = "archive string, offset long, member string, media binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, level: int = 1) -> bytes:
    """``data``, zero-padded to a positive multiple of 64, as grey samples; a private chunk has its length."""
    rows = max(1, -(-len(data) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # the first byte of a line is its filter, none
    lines[:, 1:] = np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"nbYt", struct.pack(">Q", len(data))) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples, rows x 64, and the number of bytes that are not padding."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, rows, length, packed = 8, 0, 0, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(media[at + 4 : at + 8 + n]):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not in this format")
        elif kind == b"nbYt":
            (length,) = struct.unpack(">Q", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    return lines[:, 1:], length


def features(samples: np.ndarray) -> str:
    """Size, mean, spread, entropy and an 8 x 8 average hash of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n = samples.size
    values = np.arange(256)
    mean = int(counts @ values) / n
    spread = max(0.0, int(counts @ (values * values)) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    edges = np.linspace(0, len(samples), 9).astype(int)
    columns = samples.reshape(len(samples), 8, 8).sum(axis=2, dtype=np.int64)
    cells = np.array([columns[a : max(b, a + 1)].mean(axis=0) for a, b in zip(np.minimum(edges[:-1], len(samples) - 1), edges[1:], strict=True)])
    average_hash = np.packbits(cells.ravel() > cells.mean()).tobytes().hex()
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};ahash={average_hash}"


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> None:
    """Pack (member, payload) rows into archives in ``folder``, with a Parquet manifest beside them.

    The names are unique to a task's attempt and enter the manifest only when the
    task succeeds, so repeated or lost attempts leave nothing that is read.
    """

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, held = [], None

        def close():
            archive.close()
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(held.getbuffer())
            done.append((name, held.tell(), members))

        for batch in batches:
            for member, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None:
                    held, members = io.BytesIO(), 0
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo("" if member is None else member)  # dated 1980 always: equal inputs, equal archives
                archive.writestr(info, encode_png(payload))
                members += 1
                if held.tell() >= archive_bytes:
                    close()
                    held = None
        if held is not None:
            close()
        names, sizes, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["archive", "bytes", "members"])

    rows.mapInArrow(tidy(run), "archive string, bytes long, members long").write.parquet(f"{folder}/manifest")


class _Ranges(InputPartition):
    """(path, start, stop) of one or more ranges."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.max_partitions = int(options.get("max_partitions", 20_000))
        self.tries = int(options.get("tries", 3))

    def partitions(self):
        archives = self._archives()
        step = max(self.range_bytes, -(-sum(size for _, size in archives) // self.max_partitions))
        out, held, size_held = [], [], 0
        for path, size in archives:
            for at in range(0, size, step):
                n = min(step, size - at)
                if held and size_held + n > step:
                    out.append(_Ranges(held))
                    held, size_held = [], 0
                held.append((path, at, at + n))
                size_held += n
        return [*out, _Ranges(held)]

    def _archives(self) -> list[tuple[str, int]]:
        """Those of the directory's manifest; of a directory without one, all."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector, FileType

        fs, root = filesystem(self.folder)
        if fs.get_file_info(f"{root}/manifest").type == FileType.Directory:
            found = ds.dataset(f"{root}/manifest", filesystem=fs, format="parquet", schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64())])).to_table().to_pylist()
            return sorted((f"{root}/{x['archive']}", x["bytes"]) for x in found)
        return sorted((f.path, f.size) for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".zip"))

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.folder)
        held, size = [], 0
        for path, start, stop in partition.ranges:
            file = fs.open_input_file(path)
            try:
                for m in zipfile.ZipFile(file).infolist():
                    if start <= m.header_offset < stop:
                        data, file = self._fetch(fs, path, file, m)
                        held.append((path, m.header_offset, m.filename, data))
                        size += m.file_size
                        if size >= self.batch_bytes:
                            yield _media_batch(held)
                            held, size = [], 0
            finally:
                file.close()
        if held:
            yield _media_batch(held)

    def _fetch(self, fs, path: str, file, m: zipfile.ZipInfo):
        """One member's bytes, by its offset, and the stream to go on with: another one after a failure."""
        for left in reversed(range(self.tries)):
            try:
                return read_member(file, m), file
            except (OSError, ValueError):
                if not left:
                    raise
                time.sleep(0.1)
                file.close()
                file = fs.open_input_file(path)
        raise AssertionError


def read_member(file, m: zipfile.ZipInfo) -> bytes:
    """A stored member at its local header, checked against the directory's CRC."""
    file.seek(m.header_offset)
    head = file.read(30)
    if len(head) != 30 or head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at byte {m.header_offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(m.header_offset + 30 + name + extra)
    data = file.read(m.compress_size)
    if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
        raise ValueError(f"the member at byte {m.header_offset} is damaged")
    return data


def _media_batch(held) -> pa.RecordBatch:
    archive, offset, member, media = zip(*held, strict=True)
    return pa.record_batch([pa.array(archive), pa.array(offset, pa.int64()), pa.array([x or None for x in member], pa.string()), pa.array(media, pa.binary())], ["archive", "offset", "member", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: archive, offset, member, media.

    Options: ``range_bytes`` (the size of planned ranges), ``batch_bytes``, ``tries``.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def described(media: DataFrame) -> DataFrame:
    """The decoded payload's sizes, digests and features for each (member, media) row."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for member, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, n = decode_png(data)
                payload = samples.tobytes()
                rows.append((None if member is None else int(member), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)))
            if rows:
                columns = zip(*rows, strict=True)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return media.select("member", "media").mapInArrow(tidy(run), schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Store every text as media in the shared folder, read the archives back and describe them."""
    spark = docs.sparkSession
    folder = scratch(spark, "media")
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("member"), text_or_empty(text_col).cast("binary").alias("payload"))
    write_archives(rows, folder)
    return described(read_archives(spark, folder, **options))
