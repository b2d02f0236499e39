"""Which row of a component of near copies stays: what near-duplicate operators share.

A row is known by its identifier and a hash of its text; null identifiers are the
largest, and rows that repeat both are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import text_or_empty, unused, written


def row_hash(text_col: str) -> Column:
    """What tells rows of one identifier apart: a hash of the text, null being empty."""
    return F.xxhash64(text_or_empty(text_col))


def owned(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, row, node, component_id and stays, of rows with their node and of each linked node's root.

    The smallest identifier of a component, and of its rows the one with the lowest
    hash, own it. Nodes are few where rows are many copies, and the owner of a node
    is a minimum, taken in each task first.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = rows.groupBy("node").agg(F.min(rank).alias("least"))
    of = written(least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "nodes")
    named = of.groupBy("root").agg(F.min("least").alias("owner")).select(F.xxhash64("root").alias("key"), F.col("root").alias("of"), "owner")
    linked = of.withColumn("key", F.xxhash64("root")).join(named, "key").where(F.col("root") == F.col("of")).select(F.xxhash64("node").alias("key"), F.col("node").alias("of"), "owner")
    found = rows.withColumn("key", F.xxhash64("node")).join(linked, "key").where(F.col("node") == F.col("of"))
    stays = F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("row") == F.col("owner.row"))
    return found.select("doc_id", "row", "node", F.col("owner.doc_id").alias("component_id"), stays.alias("stays"))


def without_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that don't stay, found by identifier and hash of the text.

    Few go, as a rule, and a small table of them is broadcast by Spark, so the
    texts stay where they are.
    """
    gone_id, gone_row = unused("gone_id", docs), unused("gone_row", docs)
    gone = written(decided.where("NOT stays").select(F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row)).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (row_hash(text_col) == F.col(gone_row)), "left_anti")
