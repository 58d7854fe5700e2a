"""Physical-plan properties the design relies on (checked on sf0.001)."""
from conftest import SF001

RELATIONAL = ["merge_sources", "clean_filter_dedupe", "dedupe_keep_first", "keyword_match", "first_keyword", "post_search",
              "capped_per_keyword_day", "collection_rollup", "new_ids_anti", "keyword_day_grid",
              "label_counts_zero_filled", "parse_responses", "manual_override", "confusion", "class_report",
              "macro_f1_best_c", "inline_relation", "doc_freq", "top_words"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    from __spark_entry__ import queries
    q = queries()
    for name in RELATIONAL:
        p = _plan(q[name](spark, SF001))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_caps_use_window_group_limit_and_filters_reach_the_scan(spark):
    from __spark_entry__ import queries
    q = queries()
    assert "WindowGroupLimit" in _plan(q["capped_per_keyword_day"](spark, SF001))
    anti = _plan(q["new_ids_anti"](spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in anti


def test_tfidf_vocabulary_is_broadcast(spark):
    from __spark_entry__ import queries
    p = _plan(queries()["tfidf_weights"](spark, SF001))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_texts_stay_out_of_the_range_shuffle_and_reports_take_one_pass(spark):
    import re
    from pyspark.sql import functions as F
    from ulasan.operators import positions
    from ulasan.plans.evaluate import classification_report, macro_f1
    from ulasan.operators.labelling import pending_texts
    seen = []
    real = positions.materialize
    positions.materialize = lambda df, name: seen.append(df) or real(df, name)
    try:
        rows = spark.range(100).select(F.col("id").alias("row_id"), F.concat(F.lit("text "), "id").alias("text"), F.rand(1).alias("o"))
        out = pending_texts(rows, rows.filter("row_id < 10").select("row_id"), [F.col("o").desc(), F.col("row_id")], 7)
    finally:
        positions.materialize = real
    assert "text" not in _plan(seen[0])
    got = sorted((r.pos, r.row_id, r.batch_id, r.text) for r in out.collect())
    order = sorted((-r.o, r.row_id) for r in rows.collect())
    assert got == [(k, i, k // 7, f"text {i}") for k, (_, i) in enumerate(order) if i >= 10]
    scored = spark.createDataFrame([("a", "a", 1), ("b", "a", 1), (None, "a", 1), ("b", "c", 2), ("b", None, 2)], "label string, prediction string, g int")
    scored = scored.repartition(3)
    for df in (classification_report(scored, ["a", "b"]), macro_f1(scored, ["g"], ["a", "b"])):
        assert len(re.findall(r"Join|Union", _plan(df))) == 0 and len(re.findall(r"\+- (?:HashAggregate|ObjectHashAggregate|SortAggregate)", _plan(df))) <= 2
    assert {r.g: round(r.f1_macro, 6) for r in macro_f1(scored, ["g"], ["a", "b"]).collect()} == {1: 0.25, 2: 0.0}
    report = {r.name: r for r in classification_report(scored, ["a", "b"]).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].f1, report["a"].support) == (0.333333, 1.0, 0.5, 1)
    assert (report["accuracy"].f1, report["accuracy"].support, report["weighted avg"].f1) == (0.25, 4, 0.125)
