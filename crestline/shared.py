"""The cluster's shared folder, and tables written to it."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, a local session gets a temporary folder of its own; on a cluster that
    would be seen by one machine only, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes see; intermediate tables go there")
        found = _own_folder(spark.sparkContext.applicationId)
    return found.rstrip("/")


@functools.lru_cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="crestline-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under this application's part of the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/crestline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application keeps in the shared folder.

    Results read from there, so this is for when they have been written elsewhere.
    Where nothing was kept, nothing happens.
    """
    delete(spark, f"{shared_dir(spark)}/crestline/{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that
    were running on it, since the table outlives all executors. Nulls and repeated
    rows stay, an empty table is one, and names must differ by more than case.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a table from ``written`` that nothing needs any more; other tables are left alone."""
    if path := df.__dict__.get("written_to"):
        delete(df.sparkSession, path)
