"""Streaming queries: the driver tables are written as small files and read
back as streams; each query runs to completion (availableNow) and returns the
sink table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dedupe import order_key
from ..operators.parallel import spread
from ..plans import tfidf
from ..plans.svm import OvoModel
from ..session import scratch_path
from ..streaming.jobs import daily_counts, dedupe_ingest, read_daily, read_ingested, read_scored, score_stream
from . import query
from . import sqlgen as q
from .common import tbl

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_files(spark, sf, redeliver: bool):
    """Events as a directory of small files; with ``redeliver`` the middle
    days arrive twice (as an at-least-once source would send them)."""
    path = scratch_path(spark, "events_in")
    e = tbl(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    if redeliver:
        e.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp")).repartition(4).write.parquet(path)
        e.filter(F.col("ts") >= F.lit("2024-01-11").cast("timestamp")).repartition(4) \
         .write.mode("append").parquet(path)
    else:
        e.repartition(8).write.parquet(path)
    return path


@query("stream_dedupe", "SELECT event_id, event_type FROM events")
def stream_dedupe_q(spark, sf):
    src = event_files(spark, sf, redeliver=True)
    sink, ck = scratch_path(spark, "dedupe_sink"), scratch_path(spark, "dedupe_ck")
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(src).withColumn("day", F.to_date("ts"))
    dedupe_ingest(stream, "event_id", order_key(F.col("ts")), sink, ck, day="day").awaitTermination()
    return read_ingested(spark, sink).select("event_id", "event_type")


@query("stream_daily", """
  SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_daily_q(spark, sf):
    src = event_files(spark, sf, redeliver=False)
    sink, ck = scratch_path(spark, "daily_sink"), scratch_path(spark, "daily_ck")
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 3).parquet(src)
    # every file holds rows of all days, so the delay spans them
    daily_counts(stream, "ts", "event_type", sink, ck, delay="400 days").awaitTermination()
    return read_daily(spark, sink, "event_type")


def demo_model(spark, sf):
    from .features_q import DEMO_B, demo_weights
    d = spread(tbl(spark, sf, "documents").select("doc_id", "text"))
    vocab, _ = tfidf.fit(d, "doc_id")
    model = OvoModel(vocab, demo_weights(vocab), DEMO_B, 1.0)
    path = scratch_path(spark, "demo_model")
    model.save(path)
    return OvoModel.load(spark, path)       # loaded once, used by every micro-batch


def _score_lines_sql():
    from .features_q import DEMO_B, TF_SQL
    w = [f"((((term_id * 37 + {p} * 11) % 21) - 10) / 10.0)" for p in range(3)]
    return TF_SQL + f"""
  , lines AS (SELECT {q.strip_ws('l')} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)
              WHERE {q.strip_ws('l')} <> '' AND lower({q.strip_ws('l')}) NOT IN ('exit', 'quit', 'keluar')),
  ln AS (SELECT row_number() OVER () AS lid, text FROM lines),
  lt AS (SELECT lid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM ln),
  lterms AS (SELECT lid, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
             AS term FROM lt),
  ltf AS (SELECT lid, term, count(*) AS tf FROM lterms GROUP BY 1, 2),
  lw AS (SELECT l.lid, v.term_id, (1 + ln(l.tf)) * v.idf AS raw FROM ltf l JOIN vocab v USING (term)),
  lwn AS (SELECT lid, term_id, raw / sqrt(sum(raw * raw) OVER (PARTITION BY lid)) AS weight FROM lw),
  sw AS (SELECT lid, {', '.join(f'sum(weight * {w[p]}) AS s{p}' for p in range(3))} FROM lwn GROUP BY lid),
  sc AS (SELECT ln.text, {', '.join(f'coalesce(s{p}, 0) + {DEMO_B[p]} AS s{p}' for p in range(3))}
         FROM ln LEFT JOIN sw USING (lid)),
  v AS (SELECT text, (s0 > 0)::INT + (s1 > 0)::INT AS v_neg, (s0 <= 0)::INT + (s2 > 0)::INT AS v_net,
               (s1 <= 0)::INT + (s2 <= 0)::INT AS v_pos FROM sc)
  SELECT text, CASE WHEN v_neg >= v_net AND v_neg >= v_pos THEN 'negatif'
                    WHEN v_net >= v_pos THEN 'netral' ELSE 'positif' END AS prediction FROM v"""


@query("stream_score", _score_lines_sql())
def stream_score_q(spark, sf):
    lines_dir = scratch_path(spark, "lines_in")
    tbl(spark, sf, "documents").select("text").repartition(4).write.text(lines_dir)
    model = demo_model(spark, sf)
    sink, ck = scratch_path(spark, "score_sink"), scratch_path(spark, "score_ck")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(lines_dir)
    score_stream(lines, lambda rows: model.predict(rows, "row_id"), sink, ck).awaitTermination()
    return read_scored(spark, sink)
