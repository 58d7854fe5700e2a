"""Collection queries over ``events`` (posts keyed by id, typed by keyword,
dated by ``ts``) and ``documents`` (phrase search)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import day_string, ts_string
from ..operators.collect import (cap_newest, collection_rollup, first_keyword, greedy_collect,
                                 keyword_day_grid, match_keywords, search_posts, small)
from . import query
from .common import tbl
from .sqlgen import lit

# --- fixed parameters of the registered collection queries ------------------
PHRASES = ["this", "with", "from the", "it is", "and the", "was", "de la"]
CAP = 25
GREEDY_CAP = 10
# keyword rank order; each keyword matches a set of event types (overlapping)
KEYWORD_SETS = [("purchase", ["purchase"]), ("shop", ["purchase", "click"]),
                ("activity", ["click", "view", "signup"]),
                ("any", ["purchase", "click", "view", "signup", "error"])]
# search requests: phrase, first day after the earliest event, days, language, reposts taken
SEARCHES = [("this", 0, 7, "en", False), ("from the", 3, 10, "en", False), ("with", 0, 400, "en", False),
            ("de la", 2, 5, None, False), ("y", 4, 12, "es", True), ("it is", 1, 1, None, True),
            ("this", 5, 6, "en", True), ("und", 0, 20, "de", False)]
NEW_FROM, KNOWN_BEFORE = "2024-01-11", "2024-01-16"
# ---------------------------------------------------------------------------


def _posts(spark, sf):
    e = tbl(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_type").alias("keyword"), F.to_date("ts").alias("day"))


@query("new_ids_anti", f"""
  SELECT event_id, event_type FROM events n WHERE ts >= TIMESTAMP '{NEW_FROM}'
  AND NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '{KNOWN_BEFORE}' AND o.event_id = n.event_id)""")
def new_ids_anti_q(spark, sf):
    e = tbl(spark, sf, "events")
    new = e.filter(F.col("ts") >= F.lit(NEW_FROM).cast("timestamp_ntz"))
    known = e.filter(F.col("ts") < F.lit(KNOWN_BEFORE).cast("timestamp_ntz")).select("event_id")
    return new.join(known, "event_id", "left_anti").select("event_id", "event_type")


@query("known_ids_semi", f"""
  SELECT event_id FROM events n WHERE ts >= TIMESTAMP '{NEW_FROM}'
  AND event_id IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '{KNOWN_BEFORE}')""")
def known_ids_semi_q(spark, sf):
    e = tbl(spark, sf, "events")
    new = e.filter(F.col("ts") >= F.lit(NEW_FROM).cast("timestamp_ntz"))
    known = e.filter(F.col("ts") < F.lit(KNOWN_BEFORE).cast("timestamp_ntz")).select("event_id")
    return new.join(known, "event_id", "left_semi").select("event_id")


GRID_SQL = """
  WITH kw AS (SELECT event_type AS keyword, min(ts::DATE) AS lo, max(ts::DATE) AS hi FROM events GROUP BY 1),
       r AS (SELECT min(lo) AS lo, max(hi) AS hi FROM kw)
  SELECT keyword, strftime(g.d::DATE, '%Y-%m-%d') AS day,
         keyword || ' since:' || strftime(g.d::DATE, '%Y-%m-%d') || ' until:' ||
         strftime(g.d::DATE + 1, '%Y-%m-%d') || ' lang:id -filter:retweets' AS query
  FROM kw, r, generate_series(r.lo::TIMESTAMP, r.hi::TIMESTAMP, INTERVAL 1 DAY) AS g(d)
"""


def _grid(spark, sf):
    p = _posts(spark, sf)
    kw = p.groupBy("keyword").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    everyone = Window.partitionBy()   # over the K-row keyword table only
    kw = kw.select("keyword", F.min("lo").over(everyone).alias("lo"), F.max("hi").over(everyone).alias("hi"))
    return keyword_day_grid(kw, F.col("lo"), F.col("hi")).select("keyword", "day", "query")


@query("keyword_day_grid", GRID_SQL)
def keyword_day_grid_q(spark, sf):
    return _grid(spark, sf).select("keyword", day_string(F.col("day")).alias("day"), "query")


def _match_sql(phrases):
    values = ", ".join(f"({i + 1}, {lit(p)})" for i, p in enumerate(phrases))
    return f"""
  WITH tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
       g AS (SELECT DISTINCT doc_id, unnest(list_concat(t,
               list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM tk)
  SELECT doc_id, kw_rank, phrase FROM g JOIN (VALUES {values}) AS kw(kw_rank, phrase) ON gram = phrase
"""


MATCH_SQL = _match_sql(PHRASES)


def _matches(spark, sf):
    return match_keywords(tbl(spark, sf, "documents"), PHRASES, "doc_id")


@query("keyword_match", MATCH_SQL)
def keyword_match_q(spark, sf):
    return _matches(spark, sf)


@query("first_keyword", f"""
  SELECT doc_id, kw_rank, phrase FROM ({MATCH_SQL}) QUALIFY kw_rank = min(kw_rank) OVER (PARTITION BY doc_id)""")
def first_keyword_q(spark, sf):
    return first_keyword(_matches(spark, sf), "doc_id", PHRASES)


# phrases with words of one character besides
ALL_PHRASES = PHRASES + ["is a", "a la", "y"]
MATCH_ALL_SQL = _match_sql(ALL_PHRASES)


def _matches_all(spark, sf):
    return match_keywords(tbl(spark, sf, "documents"), ALL_PHRASES, "doc_id")


@query("keyword_match_all", MATCH_ALL_SQL)
def keyword_match_all_q(spark, sf):
    return _matches_all(spark, sf)


@query("first_keyword_all", f"""
  SELECT doc_id, kw_rank, phrase FROM ({MATCH_ALL_SQL}) QUALIFY kw_rank = min(kw_rank) OVER (PARTITION BY doc_id)""")
def first_keyword_all_q(spark, sf):
    return first_keyword(_matches_all(spark, sf), "doc_id", ALL_PHRASES)


def _search_sql():
    values = ", ".join(f"({i + 1}, {lit(p)}, {a}, {n}, {lit(g) if g else 'NULL'}, {str(r).lower()})"
                       for i, (p, a, n, g, r) in enumerate(SEARCHES))
    return f"""
  WITH lo AS (SELECT min(ts)::DATE AS lo FROM events),
  rq AS (SELECT kw_rank, phrase, (lo + a)::TIMESTAMP AS since, (lo + a + n)::TIMESTAMP AS until, lang AS want, reposts
         FROM (VALUES {values}) AS v(kw_rank, phrase, a, n, lang, reposts), lo),
  tk AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
  g AS (SELECT DISTINCT doc_id, lang, unnest(list_concat(t,
          list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM tk)
  SELECT e.event_id AS post_id, kw_rank, phrase, strftime(since, '%Y-%m-%d') AS since, strftime(until, '%Y-%m-%d') AS until
  FROM events e JOIN g ON g.doc_id = e.user_id JOIN rq ON g.gram = rq.phrase
  WHERE e.ts >= since AND e.ts < until AND (want IS NULL OR g.lang = want) AND (reposts OR e.event_type <> 'view')
"""


@query("post_search", _search_sql())
def post_search_q(spark, sf):
    """The whole post predicate: phrase, half-open time range, language, reposts.
    Posts: each event, with the text and language of its user's document."""
    e = tbl(spark, sf, "events")
    posts = e.join(tbl(spark, sf, "documents"), e["user_id"] == F.col("doc_id")).select(
        F.col("event_id").alias("post_id"), F.col("ts").cast("timestamp").alias("ts"), "text", "lang",
        (F.col("event_type") == "view").alias("is_repost"))
    first = e.agg(F.to_date(F.min("ts"))).scalar()
    asked = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(SEARCHES)],
                                  "kw_rank int, phrase string, a int, n int, lang string, reposts boolean")
    requests = asked.select("kw_rank", "phrase", F.date_add(first, F.col("a")).cast("timestamp").alias("since"),
                            F.date_add(first, F.col("a") + F.col("n")).cast("timestamp").alias("until"), "lang", "reposts")
    out = search_posts(posts, requests)
    return out.select("post_id", "kw_rank", "phrase", day_string(F.to_date("since")).alias("since"),
                      day_string(F.to_date("until")).alias("until"))


CAP_SQL = f"""
  SELECT event_id, strftime(ts::DATE, '%Y-%m-%d') AS day, event_type AS keyword, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts DESC, event_id DESC) AS rk
    FROM events) WHERE rk <= {CAP}
"""


def _capped(spark, sf):
    return cap_newest(_posts(spark, sf), ["day", "keyword"], CAP, "ts", "event_id")


@query("capped_per_keyword_day", CAP_SQL)
def capped_per_keyword_day_q(spark, sf):
    return _capped(spark, sf).select("event_id", day_string(F.col("day")).alias("day"), "keyword",
                                     F.col("rk").cast("long").alias("rk"))


@query("collection_rollup", f"""
  WITH grid AS ({GRID_SQL}), cap AS ({CAP_SQL}),
  cells AS (SELECT g.day, g.keyword, count(c.event_id) AS n FROM grid g
            LEFT JOIN cap c ON g.day = c.day AND g.keyword = c.keyword GROUP BY 1, 2)
  SELECT day, keyword, sum(n)::BIGINT AS n_saved, count(*) AS n_queries FROM cells GROUP BY ROLLUP (day, keyword)""")
def collection_rollup_q(spark, sf):
    grid = _grid(spark, sf).withColumn("day", day_string(F.col("day")))
    cap = _capped(spark, sf).withColumn("day", day_string(F.col("day")))
    return collection_rollup(grid, cap, ["day", "keyword"], "event_id")


@query("latest_first", """
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type FROM events
  ORDER BY ts DESC, event_id DESC""")
def latest_first_q(spark, sf):
    e = tbl(spark, sf, "events")
    return (e.orderBy(F.col("ts").desc(), F.col("event_id").desc())
             .select("event_id", ts_string(F.col("ts").cast("timestamp")).alias("ts"), "event_type"))


def greedy_candidates(spark, sf):
    p = _posts(spark, sf)
    sets = spark.createDataFrame([(r + 1, kw, t) for r, (kw, ts) in enumerate(KEYWORD_SETS) for t in ts],
                                 "kw_rank int, phrase string, keyword string")
    known = p.filter(F.col("ts") < F.lit("2024-01-03").cast("timestamp")).select("event_id")
    cand = p.join(small(sets, sum(len(t) for _, t in KEYWORD_SETS)), "keyword").join(known, "event_id", "left_anti")
    return cand.select("day", "kw_rank", "event_id", "ts")


def _greedy_sql():
    """The sequential rule unrolled over the (fixed, short) keyword list."""
    sets = ", ".join(f"({r + 1}, {lit(t)})" for r, (_, ts) in enumerate(KEYWORD_SETS) for t in ts)
    parts = [f"""
  cand AS (SELECT p.ts::DATE AS day, s.kw_rank, p.event_id, p.ts FROM events p
           JOIN (VALUES {sets}) s(kw_rank, keyword) ON p.event_type = s.keyword
           WHERE p.event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-03'))"""]
    for r in range(1, len(KEYWORD_SETS) + 1):
        taken = " UNION ALL ".join(f"SELECT event_id FROM t{q}" for q in range(1, r))
        not_taken = f" AND event_id NOT IN ({taken})" if taken else ""
        parts.append(f"""
  t{r} AS (SELECT day, kw_rank, event_id, ts FROM cand
           WHERE kw_rank = {r}{not_taken}
           QUALIFY row_number() OVER (PARTITION BY day ORDER BY ts DESC, event_id DESC) <= {GREEDY_CAP})""")
    union = " UNION ALL ".join(f"SELECT * FROM t{r}" for r in range(1, len(KEYWORD_SETS) + 1))
    return ("WITH" + ",".join(parts) + f"""
  SELECT strftime(day, '%Y-%m-%d') AS day, kw_rank, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
  FROM ({union})""")


@query("greedy_collection", _greedy_sql())
def greedy_collection_q(spark, sf):
    out = greedy_collect(greedy_candidates(spark, sf), GREEDY_CAP, id_col="event_id", n_keywords=len(KEYWORD_SETS))
    return out.select(day_string(F.col("day")).alias("day"), "kw_rank", "event_id",
                      ts_string(F.col("ts")).alias("ts"))
