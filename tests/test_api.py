from pyspark.sql import functions as F


def test_public_api_end_to_end(spark):
    import ulasan as u
    from ulasan.session import scratch_path
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["Mantap.. enak sekali", "Mantap.. enak sekali", "buruk sekali basi", "biasa saja info", "ok"] * 8)],
        "row_id long, text string")
    cleaned = u.clean_corpus(rows, order=u.order_key(F.col("row_id")))
    assert {r.text for r in cleaned.collect()} == {"Mantap enak sekali", "buruk sekali basi", "biasa saja info"}
    b = u.make_batches(rows, spark.createDataFrame([(0,)], "row_id long"), 35).collect()
    assert sorted(r.n for r in b) == [5, 34]
    vocab, w = u.fit_tfidf(rows, "row_id")
    labelled = rows.withColumn("label", F.when(F.col("text").contains("buruk"), "negatif")
                               .when(F.col("text").contains("enak"), "positif").otherwise("netral"))
    model, split, res = u.train_classifier(labelled, [1.0], k=2, max_iter=5)
    path = scratch_path(spark, "api_model")
    u.save_model(model, path)
    pred = u.predict(u.load_model(spark, path), rows).collect()
    scored = model.score(rows, "row_id").collect()
    assert {r.row_id: r.prediction for r in pred} == {r.row_id: r.prediction for r in scored}
    assert all(r.symbol == {"positif": "+", "negatif": "-", "netral": "~"}[r.prediction] for r in scored)
    assert len(pred) == rows.count() and {r.prediction for r in pred} <= {"negatif", "netral", "positif"}
