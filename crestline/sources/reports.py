"""A sink for reports: one ``resumen.txt`` per series, published only once the whole job has written.

    write_reports(summaries, "/out")          # summaries: series_id, rank, line

A task writes its series' files into a folder of its own attempt, line by line as rows
come, so a report of any length is never held. Rows come by series and rank. When all
tasks are done, the driver moves the files of those attempts that count to their places
and deletes the rest; if one fails, it deletes all of them and no report changes. Tasks
that still run then find no place to write to, and fail too. So a repeated attempt leaves
one report, and readers never see half of one. Only the names of attempts' folders go
through the driver; it moves file by file, in threads.

Places: ``<path>/<series>/resumen.txt``. A series' name is percent-encoded but for
letters, digits and ``_.-~``; null is ``%null``, the empty name ``%empty``, ``.`` and
``..`` are encoded too, and of names beyond 200 bytes the end is replaced by a digest.
``series_of`` gives the names back. Modes: ``append`` replaces the reports of the series
that are written and leaves others; ``overwrite`` deletes all others.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from crestline.sources.ordered import opened

#: The report's file name and its first line.
FILE = "resumen.txt"
TITLE = "Momentos detectados (mejor primero):"
_STAGING, _LONGEST, _THREADS = "_staging", 200, 16


def folder_of(series: str | None) -> str:
    """The name of a series' folder."""
    if series is None:
        return "%null"
    if series in (".", ".."):
        return series.replace(".", "%2E")
    name = quote(series, safe="") or "%empty"
    if len(name) > _LONGEST:
        name = f"{name[: _LONGEST - 40].rsplit('%', 1)[0]}%-{hashlib.sha256(series.encode()).hexdigest()[:32]}"
    return name


def series_of(path: Column) -> Column:
    """A series' name from the path of its report; of a long name its beginning and digest."""
    # a path as Spark gives it is a URI, in which the folder's own percent signs are encoded once more
    name = F.replace(F.regexp_extract(path, rf"([^/]+)/{FILE}$", 1), F.lit("%25"), F.lit("%"))
    plain = F.url_decode(F.replace(F.when(name.rlike("%[-en]"), "").otherwise(name), F.lit("+"), F.lit("%2B")))
    return F.when(name == "%null", F.lit(None)).when(name == "%empty", "").when(name.contains("%-"), name).otherwise(plain)


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.title, self.overwrite = options["path"].rstrip("/"), options.get("title", TITLE), overwrite
        self.job = f"{self.path}/{_STAGING}-{uuid.uuid4().hex}"
        system, root = opened(self.job)
        system.create_dir(root)  # here alone: a task that outlives its job must not make it anew

    def write(self, iterator):
        context = TaskContext.get()
        folder = f"{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        (system, attempt), file, done = opened(folder), None, None
        system.create_dir(attempt, recursive=False)
        try:
            for row in iterator:
                name = folder_of(row["series_id"])
                if name != done:
                    if file:
                        file.close()
                    root = f"{attempt}/{name}"
                    system.create_dir(root, recursive=False)
                    if system.get_file_info(f"{root}/{FILE}").type != fs.FileType.NotFound:
                        raise ValueError(f"rows of series {row['series_id']!r} aren't together")
                    file, done = system.open_output_stream(f"{root}/{FILE}"), name
                    file.write(f"{self.title}\n\n".encode())
                if row["line"] is not None:
                    file.write(f"{row['line']}\n".encode())
        finally:
            if file:
                file.close()
        return _Attempt(folder)

    def commit(self, messages):
        system, root = opened(self.path)
        system.create_dir(root)
        staged = [info for m in messages if m for info in system.get_file_info(fs.FileSelector(opened(m.folder)[1], allow_not_found=True))]
        names = [info.base_name for info in staged]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of a series came from several tasks; write through write_reports")

        def publish(info):
            system.create_dir(f"{root}/{info.base_name}")
            system.move(f"{info.path}/{FILE}", f"{root}/{info.base_name}/{FILE}")

        with ThreadPoolExecutor(_THREADS) as threads:
            list(threads.map(publish, staged))
            if self.overwrite:
                old = [x for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and x.base_name not in set(names) and not x.base_name.startswith(_STAGING)]
                list(threads.map(lambda x: system.delete_dir(x.path), [x for x in old if system.get_file_info(f"{x.path}/{FILE}").type == fs.FileType.File]))
        self.abort(messages)

    def abort(self, messages):
        """Nothing staged stays, nor what attempts that don't count have left; those that still run fail at their next report."""
        system, root = opened(self.job)
        if system.get_file_info(root).type == fs.FileType.Directory:
            gone = f"{root}-gone"  # under this name no attempt can add to what is being deleted
            try:
                system.move(root, gone)
            except (OSError, NotImplementedError):  # a store without folders that move
                gone = root
            system.delete_dir(gone)


class ReportFiles(DataSource):
    """``df.write.format("report_files")`` of (series_id, line), together by series and in the lines' order."""

    @classmethod
    def name(cls):
        return "report_files"

    def schema(self):
        return "series_id string, line string"

    def writer(self, schema, overwrite):
        if not {"series_id", "line"} <= set(schema.names):
            raise ValueError("a report needs the columns series_id and line")
        return _Writer(self.options, overwrite)


def write_reports(summaries: DataFrame, path: str, mode: str = "append", title: str = TITLE) -> None:
    """Write (series_id, rank, line) as a report for each series.

    Null lines are left out, equal ranks come by line, a series whose lines are all
    null has a report of its title, and no rows give no report. A path may be local or a URI.
    """
    summaries.sparkSession.dataSource.register(ReportFiles)
    rows = summaries.select(F.col("series_id").cast("string").alias("series_id"), "rank", "line")
    ordered = rows.repartition("series_id").sortWithinPartitions("series_id", "rank", "line").select("series_id", "line")
    ordered.write.format("report_files").option("title", title).mode(mode).save(path)


def read_reports(spark, path: str) -> DataFrame:
    """(series_id, text) of the reports under a path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=FILE, recursiveFileLookup=True)
    return files.select(series_of(F.col("_metadata.file_path")).alias("series_id"), F.col("value").alias("text"))
