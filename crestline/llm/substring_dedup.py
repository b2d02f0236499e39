"""Substring deduplication by hashing units: lines, and the sentences within them.

A text is cut after each line break and after white space that follows a full
stop, question or exclamation mark. A unit is normalised (ASCII letters in lower
case, white space as single spaces, none at the ends) and hashed to 128 bits.
Digests are grouped globally; the occurrence in the first row, and in it the first,
is the earliest and stays. Later ones go, with their offsets in the original text
retained. Sentences are finer than the lines or paragraphs of the usual method,
since passages may be set into other lines; ``sentences=False`` gives lines alone.

A line all of whose units are repeats goes, whatever its length. ``min_run_words``
spares short repeats within other lines: a repeated sentence there goes only if it
belongs to a run of such units, one after another in its text, of at least so many
words. At 1, the default, all repeats go.

Rows are ranked by identifier and then a hash of the text, which tells rows of one
identifier apart; cuts are made by both. Grouping sends (digest, first row, count),
summed in each task first; occurrences of repeated digests then meet their group
in an equi-join that Spark can split where a line is very frequent. Units travel as
numbers; where a text is cut it is divided anew, which gives the offsets.

Cases: a null text is empty; units of white space only are none; rows that repeat
identifier and text are one, so an exact repetition removes nothing, and both
results are cut alike; rows with a null identifier come last in rank, by the hash
of their text; an empty table gives an empty result; other columns may have any
names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import fresh, slices, text_or_empty, tidy, unused

_SENTENCES = re.compile(r".+?(?:[.!?][\x20\x09-\x0D]|\n|\Z)", re.S)
_LINES = re.compile(r"[^\n]*\n|[^\n]+")


def units_of(text: str, sentences: bool = True) -> list[tuple[int, int, int, int, int, bytes]]:
    """(unit, line, start, stop, words, normalised) of a text's units; offsets are code points of the original."""
    out, line = [], 0
    for m in (_SENTENCES if sentences else _LINES).finditer(text):
        found = m.group()
        if words := found.encode().lower().split():
            out.append((len(out), line, m.start(), m.end(), len(words), b" ".join(words)))
        line += found.endswith("\n")
    return out


def row_hash(text_col: str) -> Column:
    """60 bits of the text's MD5, null being empty."""
    return F.conv(F.substring(F.md5(text_or_empty(text_col)), 1, 15), 16, 10).cast("long")


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """doc_id, row, unit, line, line_units (how many its line has), words, digest, and whether an earlier unit of the row is equal."""
    schema = "doc_id long, row long, unit int, line int, line_units int, words int, digest binary, again boolean"
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, found = set(), units_of(text, sentences)
                many = Counter(x[1] for x in found)
                for unit, line, _, _, words, key in found:
                    digest = hashlib.md5(key, usedforsecurity=False).digest()
                    rows.append((doc_id, row, unit, line, many[line], words, digest, digest in seen))
                    seen.add(digest)
                if len(rows) >= 50_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"), text_or_empty(text_col).alias("text")).mapInArrow(tidy(run), schema)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = 1, sentences: bool = True) -> DataFrame:
    """The units that go: doc_id, row, unit, words, owner_id (the document whose occurrence stays), run_words."""
    found = units(docs, id_col, text_col, sentences)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = found.groupBy("digest").agg(F.min(rank).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select(fresh("digest").alias("key"), F.col("owner.doc_id").alias("owner_id"), F.col("owner.row").alias("owner_row"))
    own = F.col("doc_id").eqNullSafe(F.col("owner_id")) & (F.col("row") == F.col("owner_row"))
    later = found.withColumn("key", fresh("digest")).drop("digest").join(groups, "key").where(F.col("again") | ~own)
    single = later.groupBy("doc_id", "row", "unit", "line", "line_units", "words").agg(F.min("owner_id").alias("owner_id"))
    text = Window.partitionBy("doc_id", "row")
    runs = single.withColumn("run", F.col("unit") - F.row_number().over(text.orderBy("unit")))
    runs = runs.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "row", "run")))
    whole_line = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "row", "line")) == F.col("line_units")
    runs = runs.withColumn("whole_line", whole_line)
    return runs.where((F.col("run_words") >= min_run_words) | F.col("whole_line")).select("doc_id", "row", "unit", "words", "owner_id", "run_words")


_SPANS = "array<struct<start:bigint,stop:bigint,words:int,owner_id:bigint>>"


def _rest(text: str, gone: list[dict], sentences: bool) -> tuple[str, list[dict]]:
    """What stays of a text without the units of ``gone``, which are in order, and their spans."""
    found, at, out, spans = units_of(text, sentences), 0, [], []
    for x in gone:
        _, _, start, stop, words, _ = found[x["unit"]]
        out.append(text[at:start])
        spans.append({"start": start, "stop": stop, "words": words, "owner_id": x["owner_id"]})
        at = stop
    return "".join([*out, text[at:]]), spans


def _cut(text_col: str, gone_col: str, sentences: bool) -> Column:
    """A struct of what stays of a text and the spans that went; of a null text nothing goes."""

    @F.arrow_udf(f"text string, removed {_SPANS}")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = [(t, None) if t is None or x is None else _rest(t, x, sentences) for t, x in zip(texts.to_pylist(), gone.to_pylist(), strict=True)]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int32()), ("owner_id", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([x for _, x in out], spans)], ["text", "removed"])

    return cut(text_col, gone_col)


def _with_cut(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, sentences: bool, how: str) -> tuple[DataFrame, str]:
    """``docs`` with a struct (text, removed) for each row, and its column's name."""
    of_id, of_row, gone, cut = (unused(x, docs) for x in ("of_id", "of_row", "gone", "cut"))
    by_row = repeated.groupBy(F.col("doc_id").alias(of_id), F.col("row").alias(of_row)).agg(F.array_sort(F.collect_list(F.struct("unit", "owner_id"))).alias(gone))
    joined = docs.join(by_row, F.col(id_col).cast("long").eqNullSafe(F.col(of_id)) & (row_hash(text_col) == F.col(of_row)), how)
    return joined.withColumn(cut, _cut(text_col, gone, sentences)).drop(of_id, of_row, gone), cut


def without_units(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """``docs`` with the repeated units cut out of the text, and ``removed``: the cut spans of the original.

    The column's name gets underscores before it if ``docs`` has one of that name.
    """
    found, cut = _with_cut(docs, repeated, id_col, text_col, sentences, "left")
    return found.withColumn(text_col, F.col(f"{cut}.text")).withColumn(unused("removed", docs), F.col(f"{cut}.removed")).drop(cut)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = 1, sentences: bool = True) -> DataFrame:
    """doc_id, text (what stays), removed (start-stop:owner_id of each cut unit), removed_words of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, _ = _with_cut(rows, repeated_units(docs, id_col, text_col, min_run_words, sentences), "doc_id", "text", sentences, "left")
    span = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"), F.lit(":"), F.coalesce(x["owner_id"].cast("string"), F.lit("")))
    words = F.aggregate("cut.removed", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    removed = F.array_join(F.transform("cut.removed", span), " ")
    return found.select("doc_id", F.col("cut.text").alias("text"), F.coalesce(removed, F.lit("")).alias("removed"), F.coalesce(words, F.lit(0)).cast("long").alias("removed_words"))


#: The query's ``min_run_words`` for sentences within lines; repeated whole lines go at any length.
OP2_RUN_WORDS = 20
OP2_SQL = r"""
WITH t AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS row FROM documents
), u AS (
  SELECT doc_id, row, unnest(regexp_extract_all(text, '(?s).+?(?:[.!?][\x20\x09-\x0D]|\n|\z)')) AS raw,
         generate_subscripts(regexp_extract_all(text, '(?s).+?(?:[.!?][\x20\x09-\x0D]|\n|\z)'), 1) AS i
  FROM t
), o AS (
  SELECT doc_id, row, i, raw, sum(length(raw)) OVER (PARTITION BY doc_id, row ORDER BY i) AS stop,
         sum(CASE WHEN raw LIKE '%' || chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row ORDER BY i) - CASE WHEN raw LIKE '%' || chr(10) THEN 1 ELSE 0 END AS line,
         trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM u
), n AS (
  SELECT doc_id, row, i, row_number() OVER (PARTITION BY doc_id, row ORDER BY i) AS unit, (stop - length(raw))::BIGINT AS start, stop::BIGINT AS stop,
         len(string_split(norm, ' ')) AS words, norm, line, count(*) OVER (PARTITION BY doc_id, row, line) AS line_units
  FROM o WHERE norm <> ''
), g AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, row, unit) AS place,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, row, unit) AS owner_id
  FROM n
), l AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id, row ORDER BY unit) AS run FROM g WHERE place > 1
), r AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id, row, run) AS run_words, count(*) OVER (PARTITION BY doc_id, row, line) = line_units AS whole_line FROM l
), c AS (
  SELECT o.doc_id, o.row, coalesce(string_agg(o.raw, '' ORDER BY o.i) FILTER (r.i IS NULL), '') AS text,
         string_agg(r.start || '-' || r.stop || ':' || coalesce(r.owner_id::VARCHAR, ''), ' ' ORDER BY r.start) AS removed, sum(r.words)::BIGINT AS removed_words
  FROM o LEFT JOIN (SELECT * FROM r WHERE run_words >= 20 OR whole_line) r ON o.doc_id IS NOT DISTINCT FROM r.doc_id AND o.row = r.row AND o.i = r.i
  GROUP BY o.doc_id, o.row
)
SELECT d.doc_id, coalesce(c.text, d.text) AS text, coalesce(c.removed, '') AS removed, coalesce(c.removed_words, 0) AS removed_words
FROM documents d LEFT JOIN (SELECT * FROM c WHERE removed IS NOT NULL) c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND ('0x' || substr(md5(coalesce(d.text, '')), 1, 15))::BIGINT = c.row
"""
