"""Term counts and the vocabulary against brute force."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ulasan.plans import tfidf

TEXTS = ["Satu dua satu dua satu", "x", "", None, "dua tiga é_1 DUA", "satu", " ".join(f"kata{i % 37} umum" for i in range(300)),
         " ".join(f"w{i}" for i in range(500)), "satu dua"]


def brute(texts):
    out = []
    for text in texts:
        t = [w for w in re.findall(r"\w{2,}", (text or "").lower())]
        out.append(Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])]))
    return out


@pytest.fixture()
def docs(spark):
    rows = [(None if i == 5 else f"d{i % 8}", t) for i, t in enumerate(TEXTS)]      # a key without value, one that comes twice
    return spark.createDataFrame(rows, "id string, text string").repartition(3)


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_doc_terms_count_every_row_on_its_own(spark, docs, monkeypatch, at_once):
    monkeypatch.setattr(tfidf, "TOKENS_AT_ONCE", at_once)
    got = Counter((r.row_id, r.term, r.tf) for r in tfidf.doc_terms(docs, "id").collect())
    keys = [None if i == 5 else f"d{i % 8}" for i in range(len(TEXTS))]
    assert got == Counter((k, w, n) for k, c in zip(keys, brute(TEXTS)) for w, n in c.items())
    assert [tuple(r) for r in tfidf.doc_terms(docs, "id", terms=F.array(F.lit("a b"), F.lit("a b"), F.lit(None))).distinct().collect() if r.row_id == "d0"] == [("d0", "a b", 2)]


def test_bucket_sums_of_the_counting_pass_are_those_of_the_terms(spark, docs):
    tf, sums = tfidf.term_table(docs, "id")
    assert "bucket" not in tf.columns
    assert {tuple(r) for r in sums.collect()} == {tuple(r) for r in tfidf.bucket_sums(tf).collect()}


@pytest.mark.parametrize("buckets, heavy", [(1 << 20, 4), (1 << 6, 1), (1, 4), (1 << 20, 1)])
def test_vocabulary_is_exact_and_rare_terms_are_not_counted_by_name(spark, docs, monkeypatch, buckets, heavy):
    monkeypatch.setattr(tfidf, "BUCKETS", buckets)
    monkeypatch.setattr(tfidf, "HEAVY", heavy)
    counts = brute(TEXTS)
    n, df = Counter(), Counter()
    for c in counts:
        n.update(c)
        df.update(c.keys())
    tf, sums = tfidf.term_table(docs, "id") if buckets == 1 << 20 else (tfidf.doc_terms(docs, "id"), None)
    for k in (1, 5, 40, 5000):
        want = sorted(n, key=lambda t: (-n[t], t))[:k]
        got = {r.term: (r.term_id, r.n, r.df) for r in tfidf.fit_vocab(tf, F.lit(9), k, sums).collect()}
        assert got == {t: (i, n[t], df[t]) for i, t in enumerate(sorted(want))}
    if buckets > 1 << 10:       # before, every distinct term was shuffled
        assert tfidf.frequent_stats(tf, 5, sums).count() < len(n) / 5


def test_terms_meet_the_vocabulary_by_a_number(spark, docs):
    tf = tfidf.doc_terms(docs, "id")
    vocab = spark.createDataFrame([("satu", 0), ("umum kata1", 1)], "term string, term_id int")
    plan = tfidf.look_up(tf, vocab)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[xxhash64\(term#\d+, 42\)\], \[__hash#\d+L\]", plan)
    got = Counter((r.term, r.term_id) for r in tfidf.look_up(tf, vocab, "left").collect())
    assert got["satu", 0] == 3 and got["umum kata1", 1] == 1 and got["dua", None] == 3


def test_training_table_has_no_more_partitions_than_its_rows_need(spark, docs, monkeypatch):
    from ulasan.plans import svm
    weighted = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("int").alias("term_id"), F.lit(1.0).alias("weight"))
    folds = spark.range(60).select(F.col("id").alias("row_id"), F.lit("netral").alias("label"), F.lit(0).alias("fold"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64")      # small files are cut as larger ones are
        data = svm.training_table(weighted, folds, 7, 60)
        assert (data.count(), data.rdd.getNumPartitions()) == (60, 1)
        assert svm._as_vectors(svm.training_frame(weighted, folds, 7).repartition(1)).rdd.getNumPartitions() > 1      # as it was read before
        monkeypatch.setattr(svm, "ROWS_PER_PART", 20)
        assert svm.training_table(weighted, folds, 7, 60).rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
