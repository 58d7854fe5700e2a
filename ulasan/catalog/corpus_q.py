"""Corpus queries: scan registry, merge, clean, dedupe, filters, scalars."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import day_string, next_day, parse_utc, ts_string
from ..functions.text import char_length, clean_text_df, strip_ws, word_count
from ..operators.counts import value_counts
from ..operators.dedupe import keep_first, order_key
from ..plans.corpus import clean_corpus, merge_sources, sort_corpus
from ..sources.registry import null_like_to_null, scan_sources
from . import query, sqlgen as q
from .common import SOURCES_SQL, tbl, test_sources, text_inputs, text_inputs_sql

MERGED_SQL = f"""
  SELECT * FROM (
    SELECT {q.strip_ws('text')} AS text, date, source, source_rank, k1, k2
    FROM (SELECT {q.null_like('text')} AS text, date, source, source_rank, k1, k2 FROM ({SOURCES_SQL}))
    WHERE text IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY source_rank, k1, k2) = 1
"""

CLEANED_SQL = f"""
  SELECT * FROM (
    SELECT {q.clean('text')} AS text, date, source, source_rank, k1, k2 FROM ({MERGED_SQL}))
  WHERE {q.strip_ws('text')} <> '' AND {q.word_count('text')} >= 2 AND length(text) >= 5
  QUALIFY row_number() OVER (PARTITION BY text
          ORDER BY (date IS NOT NULL), date, source_rank, k1, k2) = 1
"""


def merged(spark, sf):
    return merge_sources(spark, test_sources(sf))


@query("merge_sources", f"SELECT text, {q.ts('date')} AS date, source FROM ({MERGED_SQL})")
def merge_sources_q(spark, sf):
    return merged(spark, sf).select("text", ts_string("date").alias("date"), "source")


@query("source_counts", f"SELECT source, count(*) AS n FROM ({MERGED_SQL}) GROUP BY source")
def source_counts_q(spark, sf):
    return value_counts(merged(spark, sf), "source")


@query("stage_report", f"""
  SELECT m.source, m.rows_in, coalesce(c.rows_out, 0) AS rows_out, m.rows_in - coalesce(c.rows_out, 0) AS removed
  FROM (SELECT source, count(*) AS rows_in FROM ({MERGED_SQL}) GROUP BY source) m
  LEFT JOIN (SELECT source, count(*) AS rows_out FROM ({CLEANED_SQL}) GROUP BY source) c USING (source)""")
def stage_report_q(spark, sf):
    m = merged(spark, sf)
    c = clean_corpus(m)
    rin = m.groupBy("source").agg(F.count(F.lit(1)).alias("rows_in"))
    rout = c.groupBy("source").agg(F.count(F.lit(1)).alias("rows_out"))
    return (rin.join(rout, "source", "left")
               .select("source", "rows_in", F.coalesce("rows_out", F.lit(0)).cast("long").alias("rows_out"))
               .withColumn("removed", F.col("rows_in") - F.col("rows_out")))


@query("clean_chain", f"SELECT src, id, {q.clean('text')} AS cleaned FROM {text_inputs_sql()}")
def clean_chain_q(spark, sf):
    return clean_text_df(text_inputs(spark, sf), "text", "cleaned").select("src", "id", "cleaned")


@query("clean_filter_dedupe", f"SELECT text, {q.ts('date')} AS date, source FROM ({CLEANED_SQL})")
def clean_filter_dedupe_q(spark, sf):
    return clean_corpus(merged(spark, sf)).select("text", ts_string("date").alias("date"), "source")


@query("dedupe_keep_first", """
  SELECT doc_id, lang, source FROM documents
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_keep_first_q(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return keep_first(d, ["text"], order_key(F.col("doc_id"))).select("doc_id", "lang", "source")


@query("sort_nulls_first_top", f"""
  SELECT text, {q.ts('date')} AS date, source FROM ({MERGED_SQL})
  ORDER BY date ASC NULLS FIRST, source_rank, k1, k2 LIMIT 35""")
def sort_nulls_first_top_q(spark, sf):
    # the limit is the feature (first N rows of the sorted corpus, test mode)
    return sort_corpus(merged(spark, sf)).limit(35).select("text", ts_string("date").alias("date"), "source")


@query("null_text_filter", f"""
  SELECT src, id FROM {text_inputs_sql()}
  WHERE {q.null_like('text')} IS NOT NULL AND {q.strip_ws('text')} <> ''""")
def null_text_filter_q(spark, sf):
    d = text_inputs(spark, sf).withColumn("text", null_like_to_null(F.col("text")))
    return d.filter(F.col("text").isNotNull() & (strip_ws("text") != "")).select("src", "id")


@query("length_filter", f"""
  SELECT src, id, {q.word_count('c')} AS words, length(c) AS chars,
         ({q.word_count('c')} >= 2 AND length(c) >= 5) AS kept
  FROM (SELECT src, id, {q.clean('text')} AS c FROM {text_inputs_sql()})""")
def length_filter_q(spark, sf):
    d = clean_text_df(text_inputs(spark, sf), "text", "c")
    wc, n = word_count("c"), char_length("c")
    return d.select("src", "id", wc.cast("long").alias("words"), n.cast("long").alias("chars"),
                    ((wc >= 2) & (n >= 5)).alias("kept"))


@query("text_scalars", f"""
  SELECT CAST(doc_id AS VARCHAR) AS id_str, lower({q.strip_ws('text')}) AS head,
         {q.word_count('text')} AS words, round(length(text) / greatest({q.word_count('text')}, 1), 4) AS chars_per_word
  FROM documents""")
def text_scalars_q(spark, sf):
    d = tbl(spark, sf, "documents")
    wc = word_count("text")
    return d.select(F.col("doc_id").cast("string").alias("id_str"),
                    F.lower(strip_ws("text")).alias("head"),
                    wc.cast("long").alias("words"),
                    F.round(F.length("text") / F.greatest(wc, F.lit(1)), 4).alias("chars_per_word"))


def _raw_dates(spark, sf):
    e = tbl(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    raw = (F.when(F.col("event_id") % 10 == 0, F.lit("bukan tanggal"))
            .when(F.col("event_id") % 10 == 1, F.date_format("ts", "EEE MMM dd HH:mm:ss +0000 yyyy"))
            .when(F.col("event_id") % 10 == 2, F.date_format("ts", "yyyy-MM-dd"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    return e.withColumn("raw", raw)


@query("date_scalars", f"""
  SELECT event_id, raw, {q.ts('p')} AS parsed, strftime(p::DATE, '%Y-%m-%d') AS day,
         strftime(p::DATE + 1, '%Y-%m-%d') AS next_day
  FROM (SELECT event_id,
          CASE event_id % 10 WHEN 0 THEN 'bukan tanggal'
               WHEN 1 THEN strftime(ts, '%a %b %d %H:%M:%S +0000 %Y')
               WHEN 2 THEN strftime(ts, '%Y-%m-%d')
               ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS raw,
          CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN date_trunc('second', ts)
               WHEN 2 THEN date_trunc('day', ts) ELSE ts END AS p
        FROM events)""")
def date_scalars_q(spark, sf):
    d = _raw_dates(spark, sf)
    p = parse_utc("raw", ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "weekday_tz", "yyyy-MM-dd"])
    return d.withColumn("p", p).select(
        "event_id", "raw", ts_string("p").alias("parsed"), day_string(F.to_date("p")).alias("day"),
        day_string(next_day(F.to_date("p"))).alias("next_day"))


@query("scan_registry", f"""
  SELECT {q.null_like('text')} AS text, {q.ts('date')} AS date, source, k1, k2 FROM ({SOURCES_SQL})""")
def scan_registry_q(spark, sf):
    u = scan_sources(spark, test_sources(sf, extra_missing=True))
    return u.select("text", ts_string("date").alias("date"), "source", F.col("row_key")[0]["num"].alias("k1"),
                    F.coalesce(F.get("row_key", F.lit(1))["num"], F.lit(0)).alias("k2"))
