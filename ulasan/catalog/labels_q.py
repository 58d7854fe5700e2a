"""Label queries over ``labels`` (and ``documents``): label domain, counts,
batching and prompts, response parsing, state, review, splits, evaluation."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.counts import value_counts, with_share, zero_filled_counts
from ..operators.dedupe import keep_first, order_key
from ..operators.labelling import (SYMBOLS, UNKNOWN_SYMBOL, symbol_of, BATCH_SIZE, DEFAULT_LABEL, LABELS, PROMPT_HEAD, PROMPT_TAIL,
                                   REPORT_ORDER, assign_batches, batch_rows, build_prompts,
                                   labels_from_responses, parse_response, pending_slots, pending_texts, publish,
                                   with_label_column)
from ..operators.review import override_labels, sample_exact
from ..operators.split import class_weights, split_sizes, stratified_kfold, stratified_split
from ..plans.evaluate import best_param, classification_report, confusion_matrix, macro_f1
from ..session import scratch_path
from . import query
from .common import tbl
from .sqlgen import lit

# --- fixed values ------------------------------------------------------------
SAMPLE_N, SEED = 300, 42
GRID_C = [0.1, 1.0, 10.0, 100.0]
DEMO_KEYWORDS = ["the", "und", "que", "les", "with"]
# ---------------------------------------------------------------------------

LABEL_EXPR = ("CASE WHEN toxic = 1 THEN 'negatif' WHEN quality = 1 THEN 'positif' ELSE 'netral' END")
LABELED_SQL = f"(SELECT doc_id, {LABEL_EXPR} AS label FROM labels)"
SYMBOL_SQL = "CASE label " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in SYMBOLS.items()) + \
    f" ELSE {lit(UNKNOWN_SYMBOL)} END"


def label_col():
    """Label domain from the driver's flags (toxic wins over quality)."""
    return (F.when(F.col("toxic") == 1, "negatif").when(F.col("quality") == 1, "positif")
             .otherwise("netral"))


def labeled(spark, sf):
    return tbl(spark, sf, "labels").select("doc_id", label_col().alias("label"))


@query("label_map", f"SELECT doc_id, label, {SYMBOL_SQL} AS symbol FROM {LABELED_SQL}")
def label_map_q(spark, sf):
    return labeled(spark, sf).withColumn("symbol", symbol_of(F.col("label")))


@query("symbol_lookup", f"""
  SELECT d.doc_id, l.label, {SYMBOL_SQL.replace('CASE label', 'CASE l.label')} AS symbol
  FROM documents d LEFT JOIN {LABELED_SQL} l USING (doc_id)""")
def symbol_lookup_q(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id")
    return d.join(labeled(spark, sf), "doc_id", "left").withColumn("symbol", symbol_of(F.col("label")))


_ORD = ", ".join(f"({i}, {lit(v)})" for i, v in enumerate(REPORT_ORDER))


@query("label_counts_zero_filled", f"""
  SELECT d.ord, d.label, coalesce(c.n, 0)::BIGINT AS n FROM (VALUES {_ORD}) d(ord, label)
  LEFT JOIN (SELECT label, count(*) AS n FROM {LABELED_SQL} GROUP BY label) c USING (label)""")
def label_counts_zero_filled_q(spark, sf):
    return zero_filled_counts(labeled(spark, sf), "label", REPORT_ORDER)


@query("label_share", f"""
  SELECT label, n, round(n / sum(n) OVER (), 6) AS share
  FROM (SELECT label, count(*) AS n FROM {LABELED_SQL} GROUP BY label)""")
def label_share_q(spark, sf):
    return with_share(value_counts(labeled(spark, sf), "label"))


@query("value_counts_desc", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts_desc_q(spark, sf):
    return value_counts(tbl(spark, sf, "documents"), "lang")


_KW = ", ".join(f"({i}, {lit(k)})" for i, k in enumerate(DEMO_KEYWORDS))


@query("inline_relation", f"""
  SELECT k.ord, k.keyword, count(DISTINCT t.doc_id) AS n_docs FROM (VALUES {_KW}) k(ord, keyword)
  LEFT JOIN (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok
             FROM documents) t ON t.tok = k.keyword
  GROUP BY k.ord, k.keyword""")
def inline_relation_q(spark, sf):
    kw = spark.createDataFrame(list(enumerate(DEMO_KEYWORDS)), "ord int, keyword string")
    toks = (tbl(spark, sf, "documents")
            .select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("keyword")))
    hits = toks.join(F.broadcast(kw.select("keyword")), "keyword").groupBy("keyword") \
               .agg(F.count(F.lit(1)).alias("n_docs"))
    return F.broadcast(kw).join(hits, "keyword", "left").select(
        "ord", "keyword", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


# --- batching and prompts over documents, with `labels` as the done state ---------
def doc_batches(spark, sf, find=pending_texts):
    docs = tbl(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    state = tbl(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    return find(docs, state, [F.col("row_id")], BATCH_SIZE)


BATCH_SQL = f"""
  WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
  p AS (SELECT *, pos // {BATCH_SIZE} AS batch_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels))
"""


@query("batch_prompts", BATCH_SQL + f"""
  , b AS (SELECT batch_id, count(*) AS n,
            string_agg('[' || (rn - 1)::VARCHAR || '] ' || text, chr(10) ORDER BY pos) AS lines
          FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS rn FROM p) GROUP BY batch_id)
  SELECT batch_id, n, replace({lit(PROMPT_HEAD)}, '{{count}}', n::VARCHAR) || lines || {lit(PROMPT_TAIL)} AS prompt
  FROM b""")
def batch_prompts_q(spark, sf):
    b = build_prompts(batch_rows(doc_batches(spark, sf)))
    return b.select("batch_id", F.col("n").cast("long").alias("n"), "prompt")


@query("pending_batches", BATCH_SQL + f"""
  SELECT batch_id, batch_id * {BATCH_SIZE} AS start_pos,
         least(batch_id * {BATCH_SIZE} + {BATCH_SIZE}, (SELECT count(*) FROM documents)) AS end_pos,
         count(*) AS n_pending,
         ceil((SELECT count(*) FROM p) / {BATCH_SIZE})::BIGINT AS est_batches
  FROM p GROUP BY batch_id""")
def pending_batches_q(spark, sf):
    p = doc_batches(spark, sf, pending_slots)
    total = tbl(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()   # scalar subquery
    per = p.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_pending"))
    # ceil(remaining / batch size); a scalar aggregate, not a global window
    remaining = p.agg(F.count(F.lit(1))).scalar()
    per = per.withColumn("est_batches", F.ceil(remaining / F.lit(BATCH_SIZE)).cast("long"))
    return per.select("batch_id", (F.col("batch_id") * BATCH_SIZE).alias("start_pos"),
                      F.least(F.col("batch_id") * BATCH_SIZE + BATCH_SIZE, total).alias("end_pos"),
                      "n_pending", "est_batches")


# --- synthesized labeller responses: labels cut into batches, distorted by kind ------
KINDS = 7   # 0 clean, 1 fenced, 2 prose, 3 truncated, 4 bad/duplicate indices, 5 label variants, 6 null label


def _item(i, lab):
    return F.concat(F.lit('{"index": '), i.cast("string"), F.lit(', "label": '), lab, F.lit("}"))


def responses(spark, sf):
    """``(batch_id, n, row_ids, raw)``: one response per batch of 35 labelled
    rows (position order), written as a labeller would, distorted by kind."""
    lab = labeled(spark, sf).withColumnRenamed("doc_id", "row_id")
    b = batch_rows(assign_batches(lab, [F.col("row_id")], BATCH_SIZE), text="label")
    kind = F.col("batch_id") % KINDS
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    base = F.transform("texts", lambda t, i: _item(i, q(t)))
    variant = F.transform("texts", lambda t, i: F.when(i == 2, _item(i, F.lit('"senang"')))
                          .when(i == 3, F.concat(F.lit('{"index": '), i.cast("string"), F.lit("}")))
                          .otherwise(_item(i, q(F.concat(F.lit("  "), F.upper(t), F.lit(" "))))))
    extra = F.array(F.lit('{"index": 1.0, "label": "positif"}'), F.lit('{"index": "2", "label": "positif"}'),
                    F.concat(F.lit('{"index": '), (F.col("n") + 5).cast("string"), F.lit(', "label": "positif"}')),
                    F.lit('{"index": 0, "label": "negatif"}'))
    nulled = F.transform("texts", lambda t, i: F.when(i == 0, _item(i, F.lit("null"))).otherwise(_item(i, q(t))))
    arr = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    raw = (F.when(kind == 1, F.concat(F.lit("```json\n"), arr(base), F.lit("\n```")))
            .when(kind == 2, F.concat(F.lit("Berikut hasilnya: "), arr(base), F.lit(" Semoga membantu.")))
            .when(kind == 3, F.concat(F.lit("["), F.array_join(base, ", ")))
            .when(kind == 4, arr(F.concat(base, extra)))
            .when(kind == 5, arr(variant))
            .when(kind == 6, arr(nulled))
            .otherwise(arr(base)))
    return b.select("batch_id", "n", "row_ids", raw.alias("raw"))


EXPECTED_SQL = f"""
  WITH l AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS gpos FROM {LABELED_SQL}),
  b AS (SELECT doc_id, label, gpos // {BATCH_SIZE} AS batch_id,
               row_number() OVER (PARTITION BY gpos // {BATCH_SIZE} ORDER BY gpos) - 1 AS pos FROM l),
  e AS (SELECT *, batch_id % {KINDS} AS kind,
          count(*) OVER (PARTITION BY batch_id) AS n FROM b)
  SELECT doc_id, batch_id, pos, n, kind, label AS true_label,
    CASE kind WHEN 3 THEN 'fallback_netral' WHEN 6 THEN 'retry' ELSE 'ok' END AS status,
    CASE WHEN kind = 3 THEN 'netral' WHEN kind = 6 THEN NULL
         WHEN kind = 4 AND pos = 0 THEN 'negatif'
         WHEN kind = 5 AND pos IN (2, 3) THEN 'netral' ELSE label END AS parsed
  FROM e
"""


@query("parse_responses", f"SELECT batch_id, status, pos, parsed AS label FROM ({EXPECTED_SQL})")
def parse_responses_q(spark, sf):
    from ..operators.labelling import parse_responses
    return parse_responses(responses(spark, sf).select("batch_id", "n", "raw")).select(
        "batch_id", "status", F.col("pos").cast("long").alias("pos"), "label")


@query("batch_label_counts", f"""
  SELECT batch_id, parsed AS label, count(*) AS n FROM ({EXPECTED_SQL}) WHERE parsed IS NOT NULL GROUP BY 1, 2""")
def batch_label_counts_q(spark, sf):
    from ..operators.labelling import parse_responses
    p = parse_responses(responses(spark, sf).select("batch_id", "n", "raw"))
    return p.filter(F.col("label").isNotNull()).groupBy("batch_id", "label").agg(F.count(F.lit(1)).alias("n"))


def _parsed(spark, sf):
    r = responses(spark, sf)
    return r.select("batch_id", "n", "raw", parse_response(F.col("raw"), F.col("n")).alias("p"))


@query("json_labels", f"""
  SELECT batch_id, any_value(status) AS status,
         CASE any_value(kind) WHEN 3 THEN NULL WHEN 4 THEN count(*) + 4 ELSE count(*) END AS n_items
  FROM ({EXPECTED_SQL}) GROUP BY batch_id""")
def json_labels_q(spark, sf):
    return _parsed(spark, sf).select("batch_id", F.col("p.status").alias("status"),
                                     F.col("p.n_items").cast("long").alias("n_items"))


@query("default_array", f"""
  SELECT batch_id, string_agg(parsed, ',' ORDER BY pos) AS labels_csv FROM ({EXPECTED_SQL}) GROUP BY batch_id""")
def default_array_q(spark, sf):
    return _parsed(spark, sf).select("batch_id", F.array_join("p.labels", ",").alias("labels_csv"))


@query("rejected_preview", f"""
  SELECT batch_id, left('[' || string_agg('{{"index": ' || pos::VARCHAR || ', "label": "' || true_label || '"}}', ', '
                        ORDER BY pos), 200) AS preview
  FROM ({EXPECTED_SQL}) WHERE kind = 3 GROUP BY batch_id""")
def rejected_preview_q(spark, sf):
    p = _parsed(spark, sf).filter(F.col("p.status") == "fallback_netral")
    from ..operators.labelling import unfence
    return p.select("batch_id", F.left(unfence(F.col("raw")), F.lit(200)).alias("preview"))


@query("resume_publish", f"""
  SELECT l.doc_id, coalesce(e.parsed, 'netral') AS label FROM labels l LEFT JOIN ({EXPECTED_SQL}) e USING (doc_id)""")
def resume_publish_q(spark, sf):
    state = labels_from_responses(responses(spark, sf))
    rows = tbl(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    return publish(rows, state).select(F.col("row_id").alias("doc_id"), "label")


# --- state, review, splits, evaluation --------------------------------------------
@query("column_default_prune", "SELECT doc_id, NULL::VARCHAR AS label FROM labels")
def column_default_prune_q(spark, sf):
    return with_label_column(tbl(spark, sf, "labels")).select("doc_id", "label")


@query("restore_labels", f"""
  SELECT doc_id, label, run FROM (
    SELECT doc_id, label, 1 AS run FROM {LABELED_SQL} WHERE doc_id <= (SELECT quantile_disc(doc_id, 0.5) FROM labels)
    UNION ALL SELECT doc_id, CASE label WHEN 'netral' THEN 'positif' ELSE label END, 2 FROM {LABELED_SQL}
      WHERE doc_id >= (SELECT quantile_disc(doc_id, 0.25) FROM labels))
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY run DESC) = 1""")
def restore_labels_q(spark, sf):
    """Two state writes (runs) overlap; the later run wins per row."""
    lab = labeled(spark, sf)
    lb = tbl(spark, sf, "labels")
    med = lb.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY doc_id)")).scalar()
    q1 = lb.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY doc_id)")).scalar()
    run1 = lab.filter(F.col("doc_id") <= med).withColumn("run", F.lit(1))
    run2 = (lab.filter(F.col("doc_id") >= q1)
               .withColumn("label", F.when(F.col("label") == "netral", "positif").otherwise(F.col("label")))
               .withColumn("run", F.lit(2)))
    both = run1.unionByName(run2)
    return keep_first(both, ["doc_id"], order_key(-F.col("run"))).select("doc_id", "label", "run")


@query("state_roundtrip", f"""
  SELECT doc_id // {BATCH_SIZE} AS batch_id,
         '{{"done":[' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) || ']}}' AS done_json
  FROM labels GROUP BY 1""")
def state_roundtrip_q(spark, sf):
    """Append two overlapping runs to a state
    table in the shared folder, read it back, distinct ids, per-batch export."""
    path = scratch_path(spark, "label_state")
    lab = labeled(spark, sf).select(F.col("doc_id").alias("row_id"), "label",
                                    F.floor(F.col("doc_id") / BATCH_SIZE).cast("long").alias("batch_id"))
    lab.filter(F.col("label") == "positif").write.mode("append").parquet(path)   # first run
    lab.write.mode("append").parquet(path)                  # a second run re-writes those ids
    st = spark.read.parquet(path).select("row_id", "batch_id").distinct()
    return st.groupBy("batch_id").agg(
        F.to_json(F.struct(F.sort_array(F.collect_list("row_id")).alias("done"))).alias("done_json"))


@query("manual_sample", f"""
  SELECT doc_id, label FROM {LABELED_SQL} ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id LIMIT {SAMPLE_N}""")
def manual_sample_q(spark, sf):
    return sample_exact(labeled(spark, sf), "doc_id", SAMPLE_N, SEED).select("doc_id", "label")


ROTATE_SQL = "CASE label WHEN 'negatif' THEN 'netral' WHEN 'netral' THEN 'positif' ELSE 'negatif' END"
OVERRIDE_SQL = f"""
  SELECT a.doc_id, coalesce(m.label, a.label) AS label, m.doc_id IS NOT NULL AS from_manual
  FROM {LABELED_SQL} a LEFT JOIN (
    SELECT doc_id, {ROTATE_SQL} AS label FROM {LABELED_SQL}
    ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id LIMIT {SAMPLE_N}) m USING (doc_id)"""


def rotate(c):
    return F.when(c == "negatif", "netral").when(c == "netral", "positif").otherwise("negatif")


def overridden(spark, sf):
    auto = labeled(spark, sf)
    manual = sample_exact(auto, "doc_id", SAMPLE_N, SEED).withColumn("label", rotate(F.col("label")))
    return override_labels(auto, manual, "doc_id")


@query("manual_override", OVERRIDE_SQL)
def manual_override_q(spark, sf):
    return overridden(spark, sf)


@query("manual_review_loop", f"""
  SELECT count(*) FILTER (WHERE from_manual) AS n_manual, count(*) FILTER (WHERE NOT from_manual) AS n_auto,
         count(*) AS n_total FROM ({OVERRIDE_SQL})""")
def manual_review_loop_q(spark, sf):
    o = overridden(spark, sf)
    return o.agg(F.count(F.when(F.col("from_manual"), 1)).alias("n_manual"),
                 F.count(F.when(~F.col("from_manual"), 1)).alias("n_auto"),
                 F.count(F.lit(1)).alias("n_total"))


SIZES_SQL = f"""
  WITH c AS (SELECT label, count(*) AS n FROM {LABELED_SQL} GROUP BY label),
  t AS (SELECT *, sum(n) OVER () AS tot, ceil(0.2 * sum(n) OVER ())::BIGINT AS nt FROM c),
  f AS (SELECT *, floor(n * nt / tot)::BIGINT AS base, n * nt / tot - floor(n * nt / tot) AS frac FROM t),
  g AS (SELECT *, nt - sum(base) OVER () AS leftover,
               row_number() OVER (ORDER BY frac DESC, label) AS fr FROM f)
  SELECT label, n, (base + CASE WHEN fr <= leftover THEN 1 ELSE 0 END)::BIGINT AS n_test,
         (n - base - CASE WHEN fr <= leftover THEN 1 ELSE 0 END)::BIGINT AS n_train FROM g"""


@query("split_sizes", SIZES_SQL)
def split_sizes_q(spark, sf):
    return split_sizes(labeled(spark, sf))


SPLIT_SQL = f"""
  SELECT l.doc_id, l.label, CASE WHEN rk < s.n_test THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1 AS rk
    FROM {LABELED_SQL}) l JOIN ({SIZES_SQL}) s USING (label)"""


@query("stratified_split", SPLIT_SQL)
def stratified_split_q(spark, sf):
    return stratified_split(labeled(spark, sf), "doc_id", seed=SEED).select("doc_id", "label", "split")


FOLD_SQL = f"""
  WITH c AS (SELECT label, count(*) AS n FROM {LABELED_SQL} GROUP BY label),
  s AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
        FROM c),
  cnt AS (SELECT label, f, floor((a + n - 1 - f) / 5) - floor((a - 1 - f) / 5) AS k
          FROM s, range(0, 5) r(f)),
  cum AS (SELECT label, f, sum(k) OVER (PARTITION BY label ORDER BY f) AS hi FROM cnt),
  r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS rk FROM {LABELED_SQL})
  SELECT r.doc_id, r.label, min(cum.f)::INT AS fold FROM r JOIN cum ON cum.label = r.label AND r.rk < cum.hi
  GROUP BY r.doc_id, r.label"""


@query("kfold", FOLD_SQL)
def kfold_q(spark, sf):
    return stratified_kfold(labeled(spark, sf), "doc_id").select("doc_id", "label", "fold")


@query("class_weights", f"""
  SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
  FROM (SELECT label, count(*) AS n_c FROM {LABELED_SQL} GROUP BY label)""")
def class_weights_q(spark, sf):
    w = class_weights(labeled(spark, sf))
    return w.select("label", "n_c", F.round("weight", 6).alias("weight"))


# deterministic pseudo-predictions: right for 7 in 10 ids, else the next label
PRED_SQL = f"""(SELECT doc_id, label, CASE WHEN (doc_id * 7 + 3) % 10 < 7 THEN label ELSE {ROTATE_SQL} END
                AS prediction FROM {LABELED_SQL})"""


def predicted(spark, sf):
    lab = labeled(spark, sf)
    ok = (F.col("doc_id") * 7 + 3) % 10 < 7
    return lab.withColumn("prediction", F.when(ok, F.col("label")).otherwise(rotate(F.col("label"))))


@query("confusion", f"""
  SELECT d.ord, d.label, """ + ", ".join(
    f"count(p.doc_id) FILTER (WHERE p.prediction = '{v}') AS pred_{v}" for v in LABELS) + f"""
  FROM (VALUES {', '.join(f"({i}, '{v}')" for i, v in enumerate(LABELS))}) d(ord, label)
  LEFT JOIN {PRED_SQL} p USING (label) GROUP BY d.ord, d.label""")
def confusion_q(spark, sf):
    return confusion_matrix(predicted(spark, sf))


REPORT_SQL = f"""
  WITH pc AS (SELECT label, prediction, count(*) AS n FROM {PRED_SQL} GROUP BY 1, 2),
  cls AS (SELECT d.cls,
            coalesce((SELECT sum(n) FROM pc WHERE label = d.cls AND prediction = d.cls), 0) AS tp,
            coalesce((SELECT sum(n) FROM pc WHERE label = d.cls), 0) AS support,
            coalesce((SELECT sum(n) FROM pc WHERE prediction = d.cls), 0) AS predicted
          FROM (VALUES {', '.join(f"('{v}')" for v in LABELS)}) d(cls)),
  m AS (SELECT cls, tp, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p,
               CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM cls),
  f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM m)
  SELECT cls AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM f
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
  UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                   round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f"""


@query("class_report", REPORT_SQL)
def class_report_q(spark, sf):
    return classification_report(predicted(spark, sf))


# per grid point: right when (doc_id * 7 + 3 * grid_index) % 10 < threshold
THRESH = [5, 7, 7, 6]


@query("macro_f1_best_c", f"""
  WITH g AS (SELECT * FROM (VALUES {', '.join(f"({i}, {c}, {t})" for i, (c, t) in enumerate(zip(GRID_C, THRESH)))})
             v(gi, c, t)),
  folds AS ({FOLD_SQL}),
  p AS (SELECT g.gi, g.c, f.fold, f.label,
          CASE WHEN (f.doc_id * 7 + 3 * g.gi) % 10 < g.t THEN f.label ELSE {ROTATE_SQL.replace('label', 'f.label')} END
          AS prediction FROM folds f, g),
  cells AS (SELECT g.gi, g.c, fo.fold, d.cls FROM g, (SELECT DISTINCT fold FROM folds) fo,
            (VALUES {', '.join(f"('{v}')" for v in LABELS)}) d(cls)),
  st AS (SELECT c.gi, c.c, c.fold, c.cls,
           count(*) FILTER (WHERE p.label = c.cls AND p.prediction = c.cls) AS tp,
           count(*) FILTER (WHERE p.label = c.cls) AS support,
           count(*) FILTER (WHERE p.prediction = c.cls) AS predicted
         FROM cells c LEFT JOIN p ON p.gi = c.gi AND p.fold = c.fold GROUP BY 1, 2, 3, 4),
  m AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pr,
               CASE WHEN support = 0 THEN 0 ELSE tp / support END AS re FROM st),
  f1 AS (SELECT gi, c, fold, avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END) AS f1_macro
         FROM m GROUP BY 1, 2, 3),
  mean AS (SELECT gi, c, avg(f1_macro) AS mean_score FROM f1 GROUP BY 1, 2)
  SELECT c::DOUBLE AS c, round(mean_score, 6) AS mean_score, row_number() OVER (ORDER BY mean_score DESC, gi) = 1 AS is_best
  FROM mean""")
def macro_f1_best_c_q(spark, sf):
    folds = stratified_kfold(labeled(spark, sf), "doc_id")
    grid = F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(c).cast("double").alias("c"), F.lit(t).alias("t"))
                     for i, (c, t) in enumerate(zip(GRID_C, THRESH))])
    # one scored copy per grid point, exploded from the literal grid (no join)
    scored = folds.select("*", F.inline(grid)).withColumn(
        "prediction", F.when((F.col("doc_id") * 7 + 3 * F.col("gi")) % 10 < F.col("t"), F.col("label"))
        .otherwise(rotate(F.col("label"))))
    scores = macro_f1(scored, ["gi", "c", "fold"])
    best = best_param(scores, "c", "gi")
    return best.select("c", F.round("mean_score", 6).alias("mean_score"), "is_best")
