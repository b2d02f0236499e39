"""What the operators share, besides the shared folder and its tables: input tables, file systems and names."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.shared import clear_scratch, delete, drop_written, scratch, shared_dir, written

__all__ = ["SPACE", "clear_scratch", "delete", "drop_written", "filesystem", "fresh", "give_back", "scratch", "shared_dir", "slices", "table", "text_or_empty", "tidy", "unused", "written"]

#: White space as the word definitions of this package see it.
SPACE = r"[\x20\x09-\x0D]+"


def filesystem(uri: str):
    """(file system, path) of a folder's URI, for tasks that write their own formats."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def fresh(key: str):
    """A binary key as an expression of its own, equal for equal keys.

    A join right after an aggregation on the same key would take over the
    aggregation's partitioning, and then a frequent key's rows all go to one task.
    On this expression both sides are dealt out for the join, and Spark can split a
    large partition of one side over several tasks.
    """
    return F.substring(key, 1, 1 << 20)


def slices(batches, most: int = 1_000):
    """Parts of at most ``most`` rows of Arrow batches, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def tidy(run):
    """A function over batches that gives its free memory back at the end: idle Python workers stay beside the next stages."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Hand what Python, Arrow and the C library hold but don't use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, behind as many underscores as it takes to be no column of the frames."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, with all its rows and columns; it must be there, but may be empty."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))
