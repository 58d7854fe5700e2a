"""Text-feature queries over ``documents``: term statistics, top-k, TF-IDF,
word frequencies, and the linear one-vs-one scorer."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.patterns import WORD
from ..functions.text import bigrams, let, tokens
from ..operators.counts import word_frequencies
from ..operators.parallel import spread
from ..plans import tfidf
from ..plans.svm import PAIRS, ovo_vote, linear_scores
from . import query
from .common import tbl

# --- fixed parameters ------------------------------------------------------------
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "on", "as", "be", "was",
              "for", "with", "this", "are", "by", "from", "at", "an", "de", "la", "le", "et", "en"]
TOP_WORDS = 80
# ---------------------------------------------------------------------------


def docs(spark, sf):
    return spread(tbl(spark, sf, "documents").select("doc_id", "text"))


def fitted(spark, sf):
    d = docs(spark, sf)
    return tfidf.fit_transform(d, "doc_id")


TOKS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
TF_SQL = f"""
  WITH d AS (SELECT doc_id, {TOKS} AS t FROM documents),
  terms AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
            AS term FROM d),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
  st AS (SELECT term, sum(tf)::BIGINT AS n, count(*) AS df FROM tf GROUP BY term),
  vocab AS (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, n, df,
                   ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
            FROM (SELECT * FROM st ORDER BY n DESC, term LIMIT {tfidf.MAX_FEATURES})),
  w AS (SELECT tf.doc_id, v.term_id, v.term, tf.tf, (1 + ln(tf.tf)) * v.idf AS raw FROM tf JOIN vocab v USING (term)),
  wn AS (SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS norm FROM w)
"""


@query("term_counts_topk", TF_SQL + " SELECT term_id::INT AS term_id, term, n, df FROM vocab")
def term_counts_topk_q(spark, sf):
    vocab, _ = fitted(spark, sf)
    return vocab.select("term_id", "term", "n", "df")


@query("doc_freq", f"""
  SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKS}) AS term FROM documents) GROUP BY term""")
def doc_freq_q(spark, sf):
    d = docs(spark, sf)
    u = d.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return u.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("bigrams", f"""
  SELECT doc_id, greatest(len(t) - 1, 0) AS n_bigrams,
         len(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS n_distinct
  FROM (SELECT doc_id, {TOKS} AS t FROM documents)""")
def bigrams_q(spark, sf):
    d = docs(spark, sf)
    bg = let(tokens(F.col("text")), bigrams)
    return d.select("doc_id", let(bg, lambda b: F.struct(F.size(b).alias("n"),
                                                          F.size(F.array_distinct(b)).alias("u"))).alias("s")) \
            .select("doc_id", F.col("s.n").cast("long").alias("n_bigrams"),
                    F.col("s.u").cast("long").alias("n_distinct"))


@query("tfidf_weights", TF_SQL + " SELECT doc_id, term, round(raw / norm, 6) AS weight FROM wn")
def tfidf_weights_q(spark, sf):
    _, w = fitted(spark, sf)
    return w.select(F.col("row_id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


@query("doc_norms", TF_SQL + " SELECT DISTINCT doc_id, round(norm, 6) AS norm FROM wn")
def doc_norms_q(spark, sf):
    vocab, tf = tfidf.fit(docs(spark, sf), "doc_id")
    return tfidf.row_norms(tfidf.raw_weights(tf, vocab)).select(F.col("row_id").alias("doc_id"), F.round("norm", 6).alias("norm"))


@query("vocab_lookup", TF_SQL + """
  SELECT t.doc_id, sum(t.tf)::BIGINT AS n_terms, coalesce(sum(t.tf) FILTER (WHERE v.term IS NOT NULL), 0)::BIGINT AS n_in_vocab
  FROM tf t LEFT JOIN vocab v USING (term) GROUP BY t.doc_id""")
def vocab_lookup_q(spark, sf):
    d = docs(spark, sf)
    vocab, tf = tfidf.fit(d, "doc_id")      # the terms are cut once
    j = tfidf.look_up(tf, vocab.select("term", F.lit(1).alias("hit")), "left")
    return j.groupBy(F.col("row_id").alias("doc_id")).agg(
        F.sum("tf").alias("n_terms"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("tf"))), F.lit(0)).cast("long").alias("n_in_vocab"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS_SQL = f"""
  WITH w AS (SELECT CASE WHEN suffix(x, '''s') THEN x[1:-3] ELSE x END AS word
             FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']*')) AS x
                   FROM documents)),
  c AS (SELECT word, count(*) AS n FROM w
        WHERE word NOT IN ({_STOP}) AND NOT regexp_matches(word, '^[0-9]+$') AND word <> '' GROUP BY word)
"""


@query("word_frequencies", WORDS_SQL + f"""
  SELECT word, n, round(n / max(n) OVER (), 6) AS rel FROM (SELECT * FROM c ORDER BY n DESC, word LIMIT {TOP_WORDS})""")
def word_frequencies_q(spark, sf):
    return word_frequencies(docs(spark, sf), "text", TOP_WORDS, STOP_WORDS)


@query("top_words", TF_SQL + f"""
  SELECT term AS word, n FROM st WHERE position(' ' IN term) = 0 ORDER BY n DESC, term LIMIT {TOP_WORDS}""")
def top_words_q(spark, sf):
    d = docs(spark, sf)
    u = tfidf.doc_terms(d, "doc_id", terms=tokens(F.col("text")))
    top = tfidf.top_terms(tfidf.term_stats(u), TOP_WORDS)
    return top.select(F.col("term").alias("word"), "n")


# deterministic stand-in weights derived from the vocabulary ids
def demo_weights(vocab):
    return vocab.select("term_id", *[((((F.col("term_id") * 37 + p * 11) % 21) - 10) / 10.0).alias(f"w{p}")
                                     for p in range(len(PAIRS))])


DEMO_B = [(p - 1) * 0.05 for p in range(3)]
SCORES_SQL = TF_SQL + f"""
  , sw AS (SELECT doc_id, """ + ", ".join(
    f"sum(raw / norm * ((((term_id * 37 + {p} * 11) % 21) - 10) / 10.0)) AS s{p}" for p in range(3)) + f"""
         FROM wn GROUP BY doc_id),
  sc AS (SELECT d.doc_id, """ + ", ".join(f"coalesce(s{p}, 0) + {DEMO_B[p]} AS s{p}" for p in range(3)) + """
         FROM documents d LEFT JOIN sw USING (doc_id))
"""


def scored(spark, sf):
    vocab, tf = tfidf.fit(docs(spark, sf), "doc_id")
    rows = docs(spark, sf).select(F.col("doc_id").alias("row_id"))
    return linear_scores(rows, tfidf.raw_weights(tf, vocab), demo_weights(vocab), DEMO_B)


@query("linear_scores", SCORES_SQL + """
  SELECT doc_id, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM sc""")
def linear_scores_q(spark, sf):
    s = scored(spark, sf)
    return s.select(F.col("row_id").alias("doc_id"), *[F.round(f"s{p}", 6).alias(f"s{p}") for p in range(3)])


@query("ovo_vote", SCORES_SQL + """
  , v AS (SELECT doc_id, (s0 > 0)::INT + (s1 > 0)::INT AS v_neg, (s0 <= 0)::INT + (s2 > 0)::INT AS v_net,
                 (s1 <= 0)::INT + (s2 <= 0)::INT AS v_pos FROM sc)
  SELECT doc_id, CASE WHEN v_neg >= v_net AND v_neg >= v_pos THEN 'negatif'
                      WHEN v_net >= v_pos THEN 'netral' ELSE 'positif' END AS prediction FROM v""")
def ovo_vote_q(spark, sf):
    return ovo_vote(scored(spark, sf)).select(F.col("row_id").alias("doc_id"), "prediction")
