"""Lines of text files in their order, as a table and as a stream: series, byte offset, line.

A Python data source plans byte ranges of the files. A line belongs to the range in
which it begins, so any range size gives the same lines, and (series_id, offset) is
their order whatever the tasks. Lines end as in text mode: at a line feed, a carriage
return, or both as one. Bytes that aren't UTF-8 become replacement characters.

As a stream the source remembers how far it has come in each file; what a batch reads
follows from its two offsets alone, so a restart neither repeats nor loses a line. A
line counts once its end is there. The last line of a file may have none: with the
option ``whole`` (files that don't grow) the end of the file ends it too, as it
always does in a table.

    spark.dataSource.register(OrderedLines)
    spark.read.format("ordered_lines").option("glob", "*.log").load("/logs")

Options: path (a folder, whose subfolders are searched, or a file; a local path or a
URI), glob (of file names; hidden files are skipped), rangeBytes (of a task, 64 MB by
default; small files share one, and ranges are multiples of it where it would make more
than ``MOST`` tasks), whole (streams only, false by default).

Cases: empty files give no lines; an empty line is one; offsets count bytes, and a line
that is longer than a range is read by the task it begins in; a folder without files
gives an empty table; a file that shrinks or goes between planning and reading fails.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "series_id string, offset bigint, line string"
_ARROW = pa.schema([("series_id", pa.string()), ("offset", pa.int64()), ("line", pa.string())])
_END = re.compile(rb"\r\n|\n|\r")
_LEAST, _BLOCK, _ROWS = 1 << 16, 1 << 20, 10_000
#: Tasks that bytes are dealt to; each costs the driver and a worker some time, however few its bytes.
MOST = 1_000


class Range(NamedTuple):
    path: str
    start: int
    stop: int


class Ranges(InputPartition):
    """Ranges that one task reads, one after another."""

    def __init__(self, ranges: list[Range]):
        super().__init__(ranges)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def found_files(path: str, glob: str | None = None) -> list[tuple[str, int]]:
    """(path, size) of the files that a path stands for, by path."""
    system, root = opened(path)
    at = system.get_file_info(root)
    infos = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True)) if at.type == fs.FileType.Directory else []
    shown = lambda x: not any(part[:1] in ("_", ".") for part in x.path[len(root) :].split("/"))
    return sorted((x.path, x.size) for x in infos if x.type == fs.FileType.File and (x is at or shown(x)) and fnmatch.fnmatch(x.base_name, glob or "*"))


def dealt(ranges: list[Range], size: int) -> list[Ranges]:
    """Ranges cut to at most ``size`` bytes, and small ones put together up to that; a multiple of it, where ``MOST`` tasks of it don't hold all."""
    size *= max(1, -(-sum(r.stop - r.start for r in ranges) // (size * MOST)))
    cut = [Range(r.path, at, min(r.stop, at + size)) for r in ranges for at in range(r.start, r.stop, size)]
    out, held = [], size
    for r in cut:
        if held + r.stop - r.start > size:
            out.append([])
            held = 0
        out[-1].append(r)
        held += r.stop - r.start
    return [Ranges(x) for x in out]


def lines_of(file, start: int, stop: int, size: int, ended: bool = True, block: int = _BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines of an open file that begin from ``start`` to before ``stop``.

    ``size``: where the file ends. ``ended``: whether that ends a line. The byte
    before ``start`` tells whether a line begins there.
    """
    at = max(0, start - 1)
    file.seek(at)
    held, begin = b"", 0 if start == 0 else None  # begin: where the line in hand begins; none is yet
    while True:
        data = file.read(min(block, size - at - len(held)))
        held, last = held + data, at + len(held) + len(data) >= size or not data
        done = 0
        for m in _END.finditer(held):
            if m.end() == len(held) and held[-1:] == b"\r" and not last:
                break  # a line feed may follow
            if begin is not None:
                if begin >= stop:
                    return
                yield begin, held[done : m.start()]
            done, begin = m.end(), at + m.end()
            if begin < start:
                begin = None
        held, at = held[done:], at + done
        if last:
            if ended and held and begin is not None and begin < stop:
                yield begin, held
            return
        if begin is not None and begin >= stop:
            return


def last_end(file, start: int, size: int, block: int = _BLOCK) -> int:
    """The end of the last finished line of an open file, ``start`` if none ends after it; a last carriage return isn't one yet."""
    stop = size
    while stop > start:
        at = max(start, stop - block)
        file.seek(at)
        data = file.read(stop - at)
        ends = [at + m.end() for m in re.finditer(rb"\r(?!\n)|\n", data) if at + m.end() < size or m.group() == b"\n"]
        if ends:
            return ends[-1]
        stop = at
    return start


def _read(partition: Ranges, ended: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, str]] = []
    held = 0
    for path, start, stop in partition.value:
        system, root = opened(path)
        size = system.get_file_info(root).size
        if size is None or size < stop:
            raise OSError(f"{path} has {size} bytes, {stop} were planned")
        with system.open_input_file(root) as file:
            for at, line in lines_of(file, start, stop, size, ended, max(_LEAST, min(_BLOCK, stop - start))):
                rows.append((path, at, line.decode(errors="replace")))
                held += len(line)
                if len(rows) >= _ROWS or held >= 16 * _BLOCK:
                    yield _batch(rows)
                    rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Planned:
    def __init__(self, options):
        self.path, self.glob, self.size = options["path"], options.get("glob"), int(options.get("rangeBytes", 64 << 20))
        self.whole = options.get("whole", "false").lower() == "true"
        self.prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        if self.size < 1:
            raise ValueError("rangeBytes must be positive")

    def files(self) -> list[tuple[str, int]]:
        return [(self.prefix + path, size) for path, size in found_files(self.path, self.glob)]


class _Table(_Planned, DataSourceReader):
    def partitions(self):
        return dealt([Range(path, 0, size) for path, size in self.files()], self.size) or [Ranges([])]

    def read(self, partition):
        return _read(partition, True)


class _Stream(_Planned, DataSourceStreamReader):
    """Offsets: how far each file is read."""

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for path, size in self.files():
            system, root = opened(path)
            if not self.whole:
                with system.open_input_file(root) as file:
                    size = last_end(file, 0, size)
            if size:
                out[path] = size
        return out

    def partitions(self, start, end):
        return dealt([Range(path, start.get(path, 0), stop) for path, stop in sorted(end.items()) if stop > start.get(path, 0)], self.size)

    def read(self, partition):
        return _read(partition, self.whole)


class OrderedLines(DataSource):
    """``spark.read.format("ordered_lines")`` and ``spark.readStream.format("ordered_lines")``."""

    @classmethod
    def name(cls):
        return "ordered_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Table(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def read_ordered(spark, path: str, glob: str | None = None, range_bytes: int = 64 << 20):
    """(series_id, offset, line) of all lines of the files under a path."""
    return _with_options(spark, spark.read, path, glob, range_bytes)


def stream_ordered(spark, path: str, glob: str | None = None, range_bytes: int = 64 << 20, whole: bool = False):
    """The same as a stream of what comes to the files."""
    return _with_options(spark, spark.readStream, path, glob, range_bytes, whole)


def _with_options(spark, reader, path, glob, range_bytes, whole=False):
    spark.dataSource.register(OrderedLines)
    options = {"rangeBytes": str(range_bytes), "whole": str(whole).lower()} | ({"glob": glob} if glob else {})
    return reader.format("ordered_lines").options(**options).load(path)
