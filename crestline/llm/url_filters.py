"""URL filters by a temporal list join, with DataFrame functions only.

A list entry (list_name, kind, key, action, effective) says that from a date on a
domain with its subdomains, or a host's path prefix, is blocked, allowed, or off
the list. Entries of a list's key become validity intervals; a capture is joined
with the intervals of its own domains and prefixes that hold on its fetch date,
and the most specific active entry gives the verdict. Captures send one slim row
per domain label and path segment, as deep as any list entry goes; the join is
on the key, so Spark can split a hot domain's rows over tasks. It gives matches
only; captures themselves are added after it, and the verdict is a maximum over
both, pre-aggregated before its shuffle.

Hosts are compared in lower case and paths as they are. An address, such as
10.0.3.4 or [::1], is a domain without others above it.

Cases: a null or unparsable url, or a null date, has verdict ``none``; entries of
one list, key and date count as one, of which ``block`` beats ``allow`` beats
``remove``; of equally specific entries of several lists ``block`` beats
``allow``, then the first list name; entries with a null key, date or action are
void; repeated captures repeat in the result; an empty list gives ``none`` for
all and an empty table an empty result; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import text_or_empty

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)"
_ADDRESS = r"^(\d+\.\d+\.\d+\.\d+|\[.*)$"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: str) -> Column:
    """The host in lower case without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(text_or_empty(url), _AUTHORITY, 1)), r"\.$", "")


def _segments(url: str) -> Column:
    return F.filter(F.split(F.regexp_extract(text_or_empty(url), _PATH, 1), "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, list_name, valid_from, valid_to (null: open), rank, of block and allow entries.

    ``rank`` orders matches: prefixes over domains, longer keys over shorter.
    Dates bound the rows of a window: a key has one per list and day.
    """
    severity = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    valid = entries.where(F.col("key").isNotNull() & F.col("effective").isNotNull() & F.col("kind").isin("domain", "prefix"))
    host = F.substring_index("key", "/", 1)
    key = F.when(F.col("kind") == "domain", F.lower("key")).otherwise(F.concat(F.lower(host), F.col("key").substr(F.length(host) + 1, F.length("key"))))
    daily = valid.withColumn("severity", severity).where("severity IS NOT NULL").groupBy("list_name", "kind", key.alias("key"), F.to_date("effective").alias("valid_from")).agg(F.max("severity").alias("severity"))
    until = F.lead("valid_from").over(Window.partitionBy("list_name", "kind", "key").orderBy("valid_from"))
    found = daily.withColumn("valid_to", until).where("severity > 0")
    depth = F.when(F.col("kind") == "prefix", 1000 + F.size(F.split("key", "/"))).otherwise(F.size(F.split("key", r"\.")))
    return found.select("kind", "key", "list_name", "severity", "valid_from", "valid_to", depth.alias("rank"))


def _keys(entries: DataFrame) -> Column:
    """The keys under which a capture looks, from its host and segments.

    Two numbers come to the driver: the most labels and the most segments of an entry.
    """
    by_kind = {r.kind: r.depth for r in entries.groupBy("kind").agg(F.max("rank").alias("depth")).collect()}
    labels, segments = by_kind.get("domain", 0), by_kind.get("prefix", 1001) - 1001
    above = f"transform(sequence(greatest(1, size(labels) - {labels} + 1), size(labels) + 1), i -> struct('domain' AS kind, array_join(slice(labels, i, size(labels)), '.') AS key))"
    domains = F.expr(f"CASE WHEN host = '' THEN array() WHEN address THEN array(struct('domain' AS kind, host AS key)) ELSE {above} END")
    prefixes = F.expr(f"CASE WHEN host = '' THEN array() ELSE transform(sequence(0, least(size(segments), {segments})), i -> struct('prefix' AS kind, array_join(concat(array(host), slice(segments, 1, i)), '/') AS key)) END")
    return F.concat(F.filter(domains, lambda x: x["key"] != ""), prefixes)


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched") -> DataFrame:
    """page_id, url, fetched, verdict, list_name, matched_key, valid_from, valid_to of every capture."""
    active = intervals(entries)
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.to_date(date_col).alias("fetched"))
    parts = rows.select("*", host_of("url").alias("host"), _segments("url").alias("segments")).withColumn("labels", F.split("host", r"\.")).withColumn("address", F.col("host").rlike(_ADDRESS))
    looked = parts.select("page_id", "url", "fetched", F.explode(_keys(active)).alias("k")).select("page_id", "url", "fetched", "k.kind", "k.key")
    holds = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    a, b = looked.alias("a"), active.alias("b")
    # of equal ranks: the higher severity, then the first list name, whose order min_by turns round
    order = F.struct((-F.col("rank")).alias("rank"), (-F.col("severity")).alias("severity"), "list_name")
    match = F.struct("severity", "list_name", F.col("b.key").alias("key"), "valid_from", "valid_to")
    hits = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & holds).select("page_id", "url", "fetched", order.alias("hit"), match.alias("match"), F.lit(0).alias("n"))
    both = hits.unionByName(rows.withColumn("n", F.lit(1)), allowMissingColumns=True)
    best = both.groupBy("page_id", "url", "fetched").agg(F.sum("n").alias("n"), F.min_by("match", "hit").alias("m"))
    verdict = F.when(F.col("m.severity") == 2, "block").when(F.col("m.severity") == 1, "allow").otherwise("none")
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("page_id", "url", "fetched", verdict.alias("verdict"), F.col("m.list_name").alias("list_name"), F.col("m.key").alias("matched_key"), F.col("m.valid_from").alias("valid_from"), F.col("m.valid_to").alias("valid_to"))


def dated(pages: DataFrame) -> DataFrame:
    """The pages as captures: the tables have no fetch date, so one of 2024 follows from page_id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE '2024-01-01', CAST(pmod(page_id, 366) AS INT))").alias("fetched"))


def example_lists(pages: DataFrame) -> DataFrame:
    """Dated lists over the pages' own hosts, since the tables have none; they grow with the hosts.

    Two entries concern a whole domain, so a third of the captures meet one key.
    """
    hosts = pages.select(host_of("url").alias("host")).where("host <> ''").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")
    drawn = hosts.withColumn("h", number).withColumn("day", F.expr("date_add(DATE '2024-01-01', CAST(h % 200 AS INT))"))
    kinds = [
        ("h % 5 = 0", "'hosts'", "'domain'", "host", "'block'", "day"),
        ("h % 10 = 0", "'hosts'", "'domain'", "host", "'remove'", "date_add(day, 60)"),
        ("h % 20 = 0", "'hosts'", "'domain'", "host", "'block'", "date_add(day, 100)"),
        ("h % 7 = 1", "'paths'", "'prefix'", "concat(host, '/en')", "'block'", "day"),
        ("h % 9 = 2", "'trusted'", "'domain'", "host", "'allow'", "day"),
    ]
    made = drawn.select(F.explode(F.array(*(F.expr(f"CASE WHEN {when} THEN named_struct('list_name', {name}, 'kind', {kind}, 'key', {key}, 'action', {action}, 'effective', {day}) END") for when, name, kind, key, action, day in kinds))).alias("e")).where("e IS NOT NULL").select("e.*")
    fixed = pages.sparkSession.sql("SELECT * FROM VALUES ('domains', 'domain', 'example.net', 'block', DATE '2024-04-10'), ('domains', 'domain', 'example.net', 'remove', DATE '2024-08-08') AS t(list_name, kind, key, action, effective)")
    return made.unionByName(fixed)


OP7_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, url, DATE '2024-01-01' + (((page_id % 366) + 366) % 366)::INTEGER AS fetched,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)', 1)), '\.$', '') AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages
), h AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h FROM p WHERE host <> ''
), d AS (
  SELECT *, DATE '2024-01-01' + (h % 200)::INTEGER AS day FROM h
), entries AS (
  SELECT 'hosts' AS list_name, 'domain' AS kind, host AS key, 2 AS severity, day AS valid_from FROM d WHERE h % 5 = 0
  UNION ALL SELECT 'hosts', 'domain', host, 0, day + 60 FROM d WHERE h % 10 = 0
  UNION ALL SELECT 'hosts', 'domain', host, 2, day + 100 FROM d WHERE h % 20 = 0
  UNION ALL SELECT 'paths', 'prefix', host || '/en', 2, day FROM d WHERE h % 7 = 1
  UNION ALL SELECT 'trusted', 'domain', host, 1, day FROM d WHERE h % 9 = 2
  UNION ALL SELECT 'domains', 'domain', 'example.net', 2, DATE '2024-04-10'
  UNION ALL SELECT 'domains', 'domain', 'example.net', 0, DATE '2024-08-08'
), spans AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY list_name, kind, key ORDER BY valid_from) AS valid_to,
         CASE WHEN kind = 'prefix' THEN 1000 + len(string_split(key, '/')) ELSE len(string_split(key, '.')) END AS rank
  FROM entries
), looks AS (
  SELECT rid, fetched, 'domain' AS kind, unnest(list_transform(range(1, CASE WHEN regexp_matches(host, '^(\d+\.\d+\.\d+\.\d+|\[.*)$') THEN 2 ELSE len(string_split(host, '.')) + 1 END), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM p WHERE host <> ''
  UNION ALL
  SELECT rid, fetched, 'prefix', unnest(list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/'))) FROM p WHERE host <> ''
), hits AS (
  SELECT rid, s.*, row_number() OVER (PARTITION BY rid ORDER BY rank DESC, severity DESC, list_name) AS k
  FROM looks l JOIN spans s ON l.kind = s.kind AND l.key = s.key AND s.severity > 0 AND l.fetched >= s.valid_from AND (s.valid_to IS NULL OR l.fetched < s.valid_to)
)
SELECT page_id, url, fetched::VARCHAR AS fetched, CASE severity WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict,
       list_name, key AS matched_key, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to
FROM p LEFT JOIN hits ON p.rid = hits.rid AND hits.k = 1
"""
