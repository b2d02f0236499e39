"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import drop_written, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node with a link, roots excluded; root is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    nothing changes. Each step works on (node, node) rows, aggregates a node's
    neighbours with partial sums before the shuffle, and is written to the shared
    folder; the driver sees a count and a checksum. No links: an empty result.
    """
    spark = links.sparkSession
    now = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "small-star")
        before, state = state, _state(small)
        drop_written(now)
        drop_written(large)
        now = small
    return spark.createDataFrame([], now.schema).toDF("node", "root") if not state[0] else now.toDF("node", "root")
