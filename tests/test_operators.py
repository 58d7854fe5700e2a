import random

from pyspark.sql import functions as F

from conftest import SF01
from pyref import greedy
from ulasan.operators.collect import greedy_collect
from ulasan.operators.dedupe import keep_first, order_key
from ulasan.operators.labelling import assign_batches, batch_rows, pending_rows
from ulasan.operators.positions import with_positions
from ulasan.operators.split import class_weights, split_sizes, stratified_kfold
from ulasan.plans.evaluate import classification_report


def test_keep_first_is_partition_independent(spark):
    rows = [(i, f"t{i % 37}", (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string, k long")
    exp = {}
    for i, t, k in sorted(rows, key=lambda r: (r[2], r[0])):
        exp.setdefault(t, i)
    for n in (1, 5, 17):
        got = keep_first(df.repartition(n), ["text"], order_key(F.col("k"), F.col("id"))).collect()
        assert {r.text: r.id for r in got} == exp


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    got = with_positions(df, [F.col("k")], "pos", num_partitions=7).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(5000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_batches_fixture(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(80)], "row_id long, text string")
    done = spark.createDataFrame([(i,) for i in list(range(35)) + [40]], "row_id long")
    b = batch_rows(pending_rows(assign_batches(rows, [F.col("row_id")], 35), done)).collect()
    by = {r.batch_id: r for r in b}
    assert sorted(by) == [1, 2]
    assert by[1].n == 34 and 40 not in by[1].row_ids and by[1].row_ids[0] == 35
    assert by[2].n == 10 and list(by[2].row_ids) == list(range(70, 80))


def test_greedy_fixture_and_brute_force(spark):
    # fixture: one day, N=2, p5 > p4 > ... ; k1 {p5,p4,p3}, k2 {p5..p1}
    cand = [("d", 1, p, p) for p in (5, 4, 3)] + [("d", 2, p, p) for p in (5, 4, 3, 2, 1)]
    df = spark.createDataFrame(cand, "day string, kw_rank int, post_id long, ts long")
    got = sorted((r.kw_rank, r.post_id) for r in greedy_collect(df, 2, day="day").collect())
    assert got == [(1, 4), (1, 5), (2, 2), (2, 3)]
    rnd = random.Random(5)
    kws = ["a", "b", "c", "d"]
    for trial in range(3):
        posts = [(i, rnd.randint(0, 2), rnd.randint(0, 50), set(rnd.sample(kws, rnd.randint(1, 3))))
                 for i in range(300)]
        n = rnd.randint(1, 6)
        c = [(day, r, pid, ts) for pid, day, ts, ks in posts for r, k in enumerate(kws, 1) if k in ks]
        cdf = spark.createDataFrame(c, "day int, kw_rank int, post_id long, ts long")
        got = sorted((r.day, r.kw_rank, r.post_id) for r in greedy_collect(cdf, n, day="day").collect())
        assert got == greedy(posts, kws, n)


def test_split_sizes_and_weights_fixture(spark):
    rows = [("negatif",)] * 2999 + [("netral",)] * 1839 + [("positif",)] * 2334
    df = spark.createDataFrame(rows, "label string")
    s = {r.label: (r.n_test, r.n_train) for r in split_sizes(df).collect()}
    assert s == {"negatif": (600, 2399), "netral": (368, 1471), "positif": (467, 1867)}
    w = {r.label: round(r.weight, 5) for r in class_weights(df).collect()}
    assert w == {"negatif": 0.79715, "netral": 1.29998, "positif": 1.02428}


def test_kfold_sizes_match_round_robin_rule(spark):
    labels = ["a"] * 13 + ["b"] * 7 + ["c"] * 11
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "row_id long, label string")
    got = {(r.label, r.fold): 0 for r in []}
    for r in stratified_kfold(df, "row_id").collect():
        got[(r.label, r.fold)] = got.get((r.label, r.fold), 0) + 1
    srt = sorted(labels)
    for i in range(5):
        for c in "abc":
            assert got.get((c, i), 0) == sum(1 for x in srt[i::5] if x == c)


def test_report_recomputed_from_published_matrix(spark):
    m = [[476, 72, 52], [79, 220, 69], [84, 24, 359]]
    labs = ["negatif", "netral", "positif"]
    rows = [(labs[i], labs[j]) for i in range(3) for j in range(3) for _ in range(m[i][j])]
    rep = {r.name: r for r in classification_report(spark.createDataFrame(rows, "label string, prediction string"))
           .collect()}
    assert round(rep["negatif"].precision, 4) == 0.7449 and round(rep["netral"].precision, 4) == 0.6962
    assert round(rep["positif"].f1, 4) == 0.7582 and round(rep["accuracy"].f1, 4) == 0.7352
    assert round(rep["macro avg"].f1, 4) == 0.7233 and round(rep["weighted avg"].f1, 4) == 0.7330


def test_tfidf_hand_example(spark):
    from ulasan.plans import tfidf
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "id long, text string")
    _, w = tfidf.fit_transform(df, "id")
    got = {(r.row_id, r.term): round(r.weight, 6) for r in w.collect()}
    assert got == {(1, "aa"): 0.449436, (1, "bb"): 0.631667, (1, "aa bb"): 0.631667, (2, "aa"): 1.0}


def test_ovo_vote_ties_go_to_first_label(spark):
    from ulasan.plans.svm import ovo_vote
    df = spark.createDataFrame([(1, 1.0, -1.0, 1.0), (2, -1.0, -1.0, -1.0)], "row_id long, s0 double, s1 double, s2 double")
    got = {r.row_id: r.prediction for r in ovo_vote(df).collect()}
    assert got == {1: "negatif", 2: "positif"}


def test_stream_equals_batch(spark):
    from __spark_entry__ import queries
    q = queries()
    s = q["stream_daily"](spark, SF01).collect()
    e = spark.read.parquet(f"{SF01}/events.parquet")
    b = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").count().collect()
    assert sorted(tuple(r) for r in s) == sorted(tuple(r) for r in b)


def test_watermark_dedupe_keeps_one_per_key(spark):
    from ulasan.session import scratch_path
    from ulasan.streaming.jobs import dedupe_within_watermark
    src = scratch_path(spark, "wm_in")
    rows = [(i % 50, f"2024-01-01 00:{i % 60:02d}:00") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(src)
    sink, ck = scratch_path(spark, "wm_sink"), scratch_path(spark, "wm_ck")
    dedupe_within_watermark(stream, "event_id", "ts", "2 hours", sink, ck).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.count() == 50 and got.select("event_id").distinct().count() == 50


def test_model_options_train_scope_and_clean(spark):
    from conftest import SF001
    from ulasan.catalog.model_q import train_model
    model, split, ld, res = train_model(spark, SF001, Cs=[1.0], k=2, max_iter=5, fit_scope="train")
    assert res.filter("is_best").count() == 1 and res.first().max_iterations > 0
    test = ld.join(split.filter(F.col("split") == "test").select("row_id"), "row_id")
    p1 = model.predict(test, "row_id").collect()
    p2 = model.predict(test, "row_id", clean=True).collect()
    assert len(p1) == len(p2) == test.count()
    assert {r.prediction for r in p1 + p2} <= {"negatif", "netral", "positif"}


def test_pairs_are_fitted_on_vectors_read_as_such(spark):
    from ulasan.plans import tfidf
    from ulasan.plans.svm import balanced_weights, fit_ovo, linear_scores, ovo_vote, training_frame, weight_table
    rows = [(i, ("bagus sekali enak" if i % 3 == 0 else "buruk jelek basi" if i % 3 == 1 else "biasa saja info"),
             ["positif", "negatif", "netral"][i % 3]) for i in range(60)] + [(60, "?", "netral")]
    df = spark.createDataFrame(rows, "row_id long, text string, label string")
    vocab, tf = tfidf.fit(df, "row_id")
    size = vocab.count()
    train = training_frame(tfidf.transform(tf, vocab), df.select("row_id", "label"), size)
    assert train.count() == 61          # the row without a known term too
    vector = train.where("row_id = 0").first().features
    assert vector.size == size and abs(vector.norm(2) - 1) < 1e-9
    counts = {"positif": 20, "negatif": 20, "netral": 21}
    assert balanced_weights({"a": 1, "b": 3, "c": 0}) == {"a": 2.0, "b": 4 / 6}
    fits = fit_ovo(train.coalesce(1), 1.0, counts, max_iter=5)
    assert all(0 < f["iterations"] <= 5 and f["converged"] == (f["iterations"] < 5) for f in fits)
    pred = ovo_vote(linear_scores(df.select("row_id"), tfidf.raw_weights(tf, vocab), weight_table(spark, fits, size), [f["b"] for f in fits]))
    acc = pred.join(df, "row_id").filter(F.col("prediction") == F.col("label")).count() / 61
    assert acc > 0.9


def test_held_out_margins_equal_each_fold_scored_alone(spark):
    import numpy as np
    from ulasan.plans import svm
    rng = np.random.default_rng(2)
    weighted = spark.createDataFrame([(i, int(t), float(rng.random())) for i in range(12) for t in rng.choice(6, 3, False)],
                                     "row_id long, term_id int, weight double")
    held = spark.createDataFrame([(i, i % 2, "netral") for i in range(13)], "row_id long, fold int, label string")
    fits = {(g, f, p): {"coef": rng.normal(size=6), "b": float(rng.normal())} for g in range(2) for f in range(2) for p in range(3)}
    got = {(r.gi, r.row_id): (r.s0, r.s1, r.s2) for r in svm._held_out_margins(weighted, held, fits, 2, 2, 6).collect()}
    assert len(got) == 26
    rows = {}
    for r in weighted.collect():
        rows.setdefault(r.row_id, []).append((r.term_id, r.weight))
    for (g, i), margins in got.items():
        for p, m in enumerate(margins):
            fit = fits[g, i % 2, p]
            assert abs(m - fit["b"] - sum(w * fit["coef"][t] for t, w in rows.get(i, []))) < 1e-9


def test_label_job_resumes_and_exits_early(spark):
    from ulasan.catalog.model_q import offline_labeller
    from ulasan.operators.labelling import label_job
    from ulasan.session import scratch_path
    rows = spark.createDataFrame([(i, f"teks nomor {i}") for i in range(80)], "row_id long, text string")
    state = scratch_path(spark, "state")
    # a first run interrupted after some rows: seed the state with rows 0..34 and 40
    seed = spark.createDataFrame([(i, "netral", 0) for i in list(range(35)) + [40]],
                                 "row_id long, label string, batch_id long") \
                .withColumn("labelled_at", F.current_timestamp())
    seed.write.parquet(state)
    r1 = label_job(rows, state, offline_labeller)
    assert r1 == {"pending": 44, "labelled": 80}
    assert label_job(rows, state, offline_labeller) == {"pending": 0, "labelled": 0}
    got = {r.row_id: r.label for r in spark.read.parquet(state).collect()}
    exp = offline_labeller(None, [[f"teks nomor {i}"] for i in range(80)])
    assert got[50] == ["negatif", "netral", "positif"][len("teks nomor 50") % 3]


def test_build_corpus_reports_stage_counts(spark):
    from conftest import SF001
    from ulasan.catalog.common import test_sources
    from ulasan.plans.corpus import build_corpus
    from ulasan.session import scratch_path
    rep = build_corpus(spark, test_sources(SF001), scratch_path(spark, "merged"), scratch_path(spark, "cleaned"))
    assert rep["rows_before"] >= rep["rows_after"] > 0
    assert rep["removed"] == rep["rows_before"] - rep["rows_after"]


def test_day_range_param(spark):
    from ulasan.functions.dates import day_range
    got = spark.range(1).select(F.size(day_range("2025-01-30", "2025-02-02")).alias("n")).first().n
    assert got == 4


def test_resume_after_a_killed_run_equals_one_run(spark):
    from ulasan.catalog.model_q import offline_labeller
    from ulasan.operators.labelling import label_job
    from ulasan.session import scratch_path
    rows = spark.createDataFrame([(i, "x" * (i % 7 + 2) + f" teks {i}") for i in range(100)],
                                 "row_id long, text string")
    one = scratch_path(spark, "state_one")
    label_job(rows, one, offline_labeller)
    full = {r.row_id: r.label for r in spark.read.parquet(one).collect()}
    # a run that committed batch 0 and then died
    killed = scratch_path(spark, "state_killed")
    spark.read.parquet(one).filter(F.col("batch_id") == 0).write.parquet(killed)
    label_job(rows, killed, offline_labeller)
    resumed = spark.read.parquet(killed)
    assert resumed.count() == 100 == resumed.select("row_id").distinct().count()
    assert {r.row_id: r.label for r in resumed.collect()} == full


def test_keywords_of_one_character_and_all_languages(spark):
    from ulasan.operators.collect import match_keywords
    posts = spark.createDataFrame(
        [(1, "Vitamin C, murah", "id"), (2, "vitamin a saja", "en"), (3, "makan x gratis", "en"), (4, "makan gratis!", None)],
        "post_id long, text string, lang string")
    phrases = ["vitamin c", "makan gratis"]
    hits = lambda **k: sorted((r.post_id, r.kw_rank) for r in match_keywords(posts, phrases, "post_id", **k).collect())
    assert hits() == [(1, 1), (4, 2)]
    assert hits(lang="id") == [(1, 1)]
    assert hits(lang="en", min_len=2) == [(2, 1), (3, 2)]


def test_many_phrases_equal_brute_force_on_both_plans(spark, monkeypatch):
    import random
    import re
    from ulasan.operators import collect
    rng = random.Random(4)
    words = [f"k{i}" for i in range(60)] + ["a", "é"]
    phrases = list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))) for _ in range(6000)))[:5000]
    rows = [(i, ", ".join(rng.choice(words) for _ in range(30)).upper()) for i in range(40)]
    want = set()
    for i, text in rows:
        t = re.findall(r"\w+", text.lower())
        grams = {" ".join(t[x:x + n]) for n in (1, 2, 3) for x in range(len(t) - n + 1)}
        want |= {(i, rank + 1) for rank, p in enumerate(phrases) if p in grams}
    posts = spark.createDataFrame(rows, "post_id long, text string")
    for bits, broadcast in ((1 << 24, 100_000), (64, 100_000), (1 << 24, 10)):      # a full filter passes all, the join decides
        monkeypatch.setattr(collect, "FILTER_MAX_BITS", bits)
        monkeypatch.setattr(collect, "BROADCAST_MAX_KEYWORDS", broadcast)
        got = collect.match_keywords(posts, phrases, "post_id").collect()
        assert len(got) == len(want) and {(r.post_id, r.kw_rank) for r in got} == want


def _search_case():
    import datetime as dt
    import re
    rng = random.Random(12)
    at = dt.datetime(2024, 3, 1)
    words = ["makan", "gratis", "bergizi", "enak", "x", "é"]
    posts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) if i % 23 else None,
              at + dt.timedelta(hours=6 * rng.randint(0, 120)) if i % 29 else None,
              rng.choice(["id", "en", None]), rng.choice([True, False, None])) for i in range(400)]
    posts += posts[:5]
    requests = [(k, rng.choice(["makan", "Makan Gratis", "x", "gratis, enak x", "", "é"]),
                 at + dt.timedelta(hours=6 * a), at + dt.timedelta(hours=6 * (a + n)), rng.choice(["id", "en", None]),
                 rng.choice([True, False, None]))
                for k, (a, n) in enumerate([(rng.randint(0, 100), rng.choice([-2, 0, 1, 4, 4, 4, 40, 900])) for _ in range(40)])]
    requests += [(90, "makan", None, at, None, True), (91, "makan", at, None, None, True)]
    want = []
    for i, text, ts, lang, repost in posts:
        t = " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "
        for k, phrase, since, until, asked, reposts in requests:
            p = " ".join(re.findall(r"\w+", phrase.lower()))
            if (p and f" {p} " in t and ts is not None and since is not None and until is not None and since <= ts < until
                    and (asked is None or asked == lang) and (reposts or not repost)):
                want.append((i, k))
    return posts, requests, want


def test_search_posts_equals_brute_force(spark, monkeypatch):
    from ulasan.operators import collect
    posts, requests, want = _search_case()
    p = spark.createDataFrame(posts, "post_id long, text string, ts timestamp, lang string, is_repost boolean")
    r = spark.createDataFrame(requests, "kw_rank int, phrase string, since timestamp, until timestamp, lang string, reposts boolean")
    assert len(want) > 100
    for broadcast in (100_000, 0):
        monkeypatch.setattr(collect, "BROADCAST_MAX_KEYWORDS", broadcast)
        out = collect.search_posts(p, r)
        assert sorted((x.post_id, x.kw_rank) for x in out.collect()) == sorted(want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "split(" not in plan
    assert collect.search_posts(p.limit(0), r).count() == 0 and collect.search_posts(p, r.limit(0)).count() == 0
