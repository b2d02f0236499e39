"""From raw documents to token ids: clean, deduplicated and mixed to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept,
and returns the columns of documents; the last returns ids. Between stages the rows
are written as Parquet and read again.

Cases: a null text is the empty one in every stage, and null ids in the last; empty
texts are one another's copies, and the mix takes none of them; rows with a null
identifier are documents like others, the last in rank; of rows that repeat each
other one is kept by exact deduplication, and the mix may take it several times; a
null source is a source; other columns stay with their rows; an empty table goes
through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crestline.llm import exact_dedup, mixing, near_text, sentencepiece_codec, toxicity
from crestline.llm.common import drop_written, table, written


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays."""
    return exact_dedup.keep_first(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 of their 5-word shingles the smallest identifier stays.

    SimHash by the general pigeonhole principle links the closest; no radius at an
    acceptable cost finds all, as ``near_text`` explains with figures, so MinHash bands
    give the candidates beyond it. All are verified.
    """
    return near_text.keep_one(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(docs)


def _sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip of each row."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("simhash_near_dedup", _near_dedup),
    ("mixing", _mixing),
    ("sentencepiece", _sentencepiece),
]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
