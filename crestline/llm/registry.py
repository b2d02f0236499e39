"""The queries of the operators: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from crestline.llm import collocations, exact_dedup, filter_audit, hnsw, html_text, media, mixing, sentencepiece_codec, simhash, substring_dedup, toxicity, url_filters, warc
from crestline.llm.common import table


def op1_media_columns(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"), min_run_words=substring_dedup.OP2_RUN_WORDS)


def op3_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = url_filters.filter_urls(url_filters.dated(pages), url_filters.example_lists(pages))
    return found.withColumns({c: found[c].cast("string") for c in ("fetched", "valid_from", "valid_to")})


def op8_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 50 = 0"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_media_columns, op2_substring_dedup, op3_sentencepiece, op4_simhash_near_dedup, op5_html_extraction, op6_toxicity, op7_url_filters, op8_warc, op9_exact_dedup, op10_mixing, op11_nearest_neighbours, op12_filter_audit, op13_collocations)}


def oracle_sql():
    return {"op2_substring_dedup": substring_dedup.OP2_SQL, "op7_url_filters": url_filters.OP7_SQL, "op8_warc": warc.OP8_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op10_mixing": mixing.OP10_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
