"""Linear SVM, one-vs-one.

Training is one path at every size: Spark ML's ``LinearSVC`` for each pair of
classes, distributed over the rows. Balanced class weights are those of the rows
a fit sees (each fold has its own), and ``regParam = 1/(C·Σw)`` gives the averaged
hinge loss + (regParam/2)·||w||² the same minimiser as 0.5·||w||² + C·Σ wᵢ·hingeᵢ.
The fits of a grid are independent jobs submitted from a small thread pool; all
held-out rows are then scored in one pass, by a weight table with one row per
(fold, term) and one column per (C, pair). Every fit reports its iterations and
whether it converged.

Vectors are built by the JVM: indices and values are gathered natively and
written as a table in the vector type's own layout, which is read back as it.

Scoring never builds vectors: in-vocabulary TF-IDF rows join the weight table
(one row per vocabulary term, bounded by ``max_features``), one aggregation
gives the three pair margins per row, and the vote is a column expression (ties
go to the first label).
"""
from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labelling import LABELS, symbol_of
from ..operators.split import stratified_kfold
from ..session import materialize, scratch_path
from . import tfidf
from .evaluate import best_param, macro_f1

PAIRS = [(0, 1), (0, 2), (1, 2)]   # indices into LABELS; margin > 0 votes the first


# --- scoring (relational) ------------------------------------------------------------
def linear_scores(rows: DataFrame, raw: DataFrame, weights: DataFrame, intercepts: list[float]) -> DataFrame:
    """``(row_id, s0, s1, s2)``: margins of the three pair classifiers for
    every row of ``rows`` (rows without known terms get the intercepts).
    ``raw`` holds ``(row_id, term_id, raw)``; the length of a row's vector is
    summed in the same aggregate as its margins."""
    # a row for each vocabulary term, max_features at most
    j = raw.select("row_id", "term_id", "raw").join(F.broadcast(weights), "term_id", "left")
    names = [f"s{p}" for p in range(len(PAIRS))]
    sums = j.groupBy("row_id").agg(F.sum(F.col("raw") * F.col("raw")).alias("q"),
                                   *[F.sum(F.col("raw") * F.col(f"w{p}")).alias(n) for p, n in enumerate(names)])
    out = rows.select("row_id").join(sums, "row_id", "left")
    return out.select("row_id", *[(F.coalesce(F.col(n) / F.sqrt("q"), F.lit(0.0)) + F.lit(float(b))).alias(n)
                                  for n, b in zip(names, intercepts)])


def ovo_vote(scores: DataFrame) -> DataFrame:
    """One vote per pair; most votes wins, ties to the earliest label."""
    votes = [F.lit(0)] * len(LABELS)
    for p, (a, b) in enumerate(PAIRS):
        pos = (F.col(f"s{p}") > 0).cast("int")
        votes[a] = votes[a] + pos
        votes[b] = votes[b] + (F.lit(1) - pos)
    pred = F.lit(LABELS[-1])
    for i in reversed(range(len(LABELS) - 1)):
        beats = F.lit(True)
        for j in range(i + 1, len(LABELS)):
            beats = beats & (votes[i] >= votes[j])
        for j in range(i):
            beats = beats & (votes[i] > votes[j])
        pred = F.when(beats, F.lit(LABELS[i])).otherwise(pred)
    return scores.withColumn("prediction", pred)


# --- vectors and fitting ---------------------------------------------------------------
def to_vectors(weighted: DataFrame, size: int) -> DataFrame:
    """``(row_id, features)``: sparse vectors. They are written in the layout of
    the vector type (0 = sparse) and read back as that type."""
    g = weighted.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("x"))
    return _as_vectors(g.select("row_id", F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("x.term_id").alias("indices"),
        F.col("x.weight").alias("values")).alias("features")))


def _as_vectors(df: DataFrame) -> DataFrame:
    """``df`` as a table whose ``features`` are read as vectors."""
    path = scratch_path(df.sparkSession, "vectors")
    df.write.parquet(path)
    kinds = [T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in df.schema.fields]
    return df.sparkSession.read.schema(T.StructType(kinds)).parquet(path)


def balanced_weights(counts: dict[str, int]) -> dict[str, float]:
    """Weight of each class with rows: all rows / (classes · its rows)."""
    counts = {c: n for c, n in counts.items() if n}
    return {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}


def fit_pair(rows: DataFrame, a: str, b: str, C: float, counts: dict[str, int], max_iter: int, tol: float) -> dict:
    """One pair classifier on ``(label, features)``; ``counts`` are the rows of
    each class. A pair without rows of both classes votes for the one it has."""
    weights = balanced_weights(counts)
    if a not in weights or b not in weights:
        return {"coef": None, "b": 1.0 if a in weights else -1.0, "iterations": 0, "converged": True}
    sub = rows.filter(F.col("label").isin(a, b)).select(
        "features", (F.col("label") == a).cast("double").alias("y"),
        F.when(F.col("label") == a, F.lit(weights[a])).otherwise(F.lit(weights[b])).alias("w"))
    total = weights[a] * counts[a] + weights[b] * counts[b]
    model = LinearSVC(featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / (C * total), standardization=False,
                      maxIter=max_iter, tol=tol).fit(sub)
    n = model.summary().totalIterations
    return {"coef": model.coefficients.toArray(), "b": float(model.intercept), "iterations": int(n), "converged": n < max_iter}


def fit_ovo(train: DataFrame, C: float, counts: dict[str, int], max_iter: int = 30, tol: float = 1e-2) -> list[dict]:
    """The pair classifiers on ``(label, features)``, in the order of ``PAIRS``."""
    return [fit_pair(train, LABELS[a], LABELS[b], C, counts, max_iter, tol) for a, b in PAIRS]


def _coefficients(fits: list[dict], size: int) -> np.ndarray:
    return np.stack([np.zeros(size) if f["coef"] is None else f["coef"] for f in fits], axis=1)


def weight_table(spark: SparkSession, fits: list[dict], size: int) -> DataFrame:
    """``(term_id, w0, w1, w2)``: one row a vocabulary term."""
    frame = pd.DataFrame(_coefficients(fits, size), columns=[f"w{p}" for p in range(len(fits))])
    frame.insert(0, "term_id", np.arange(size, dtype=np.int32))
    return spark.createDataFrame(frame)


def training_frame(weighted: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``labels`` (``row_id, label, ...``) with ``features``; a row without known
    terms has the empty vector."""
    filled = weighted.select("row_id", "term_id", "weight").unionByName(
        labels.select("row_id", F.lit(0).alias("term_id"), F.lit(0.0).alias("weight")))
    one = filled.groupBy("row_id", "term_id").agg(F.sum("weight").alias("weight"))
    return labels.join(to_vectors(one.join(labels.select("row_id"), "row_id", "left_semi"), size), "row_id")


class OvoModel:
    def __init__(self, vocab: DataFrame, weights: DataFrame, intercepts: list[float], C: float):
        self.vocab, self.weights, self.intercepts, self.C = vocab, weights, intercepts, C

    def predict(self, docs: DataFrame, id_col: str, text_col: str = "text", clean: bool = False) -> DataFrame:
        """``(row_id, prediction)`` for every row of ``docs``.
        ``clean=False`` scores the raw text as the reference's scorer does;
        ``clean=True`` applies the training-time cleaning chain first."""
        if clean:
            from ..functions.text import clean_text
            docs = docs.withColumn(text_col, clean_text(text_col))
        tf = tfidf.doc_terms(docs, id_col, text_col)
        raw = tfidf.raw_weights(tf, self.vocab)
        rows = docs.select(F.col(id_col).alias("row_id"))
        return ovo_vote(linear_scores(rows, raw, self.weights, self.intercepts)).select("row_id", "prediction")

    def score(self, docs: DataFrame, id_col: str, text_col: str = "text", clean: bool = False) -> DataFrame:
        """``(row_id, text, prediction, symbol)`` for every row of ``docs``."""
        pred = self.predict(docs, id_col, text_col, clean)
        return (docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).join(pred, "row_id")
                .withColumn("symbol", symbol_of(F.col("prediction"))))

    def save(self, path: str) -> None:
        """Vocabulary and weights as Parquet, scalars as a one-row JSON table."""
        spark = self.vocab.sparkSession
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        meta = json.dumps({"intercepts": self.intercepts, "C": self.C, "labels": LABELS, "pairs": PAIRS})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> OvoModel:
        """A10: load once; the weight table is broadcast at scoring time."""
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        return OvoModel(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/weights"),
                        meta["intercepts"], meta["C"])


ROWS_PER_PART = 50_000


def n_partitions(n_rows: int) -> int:
    """Iterative solvers pay per task per iteration: the training frame has one
    partition per ``ROWS_PER_PART`` rows (many at scale, one when tiny)."""
    return max(1, -(-n_rows // ROWS_PER_PART))


def size_partitions(df: DataFrame, n_rows: int) -> DataFrame:
    return df.repartition(n_partitions(n_rows))


def training_table(weighted: DataFrame, folds: DataFrame, size: int, n_rows: int) -> DataFrame:
    """``training_frame`` as a table, not a cache: each of the many small jobs of a
    fit carries its lineage. A scan cuts a small file into a split for each core,
    all but one of them without a row group and each a task in every iteration, so
    the splits are put together again."""
    return _as_vectors(size_partitions(training_frame(weighted, folds, size), n_rows)).coalesce(n_partitions(n_rows))


def _held_out_margins(weighted: DataFrame, held: DataFrame, fits: dict, n_grid: int, k: int, size: int) -> DataFrame:
    """``(gi, row_id, fold, label, s0, s1, s2)``: margins of every held-out row by
    the models of its fold, for all grid points in one pass."""
    spark, n_pairs = weighted.sparkSession, len(PAIRS)
    names = [f"w{gi}_{p}" for gi in range(n_grid) for p in range(n_pairs)]
    tables = []
    for f in range(k):
        t = pd.DataFrame(np.concatenate([_coefficients([fits[gi, f, p] for p in range(n_pairs)], size) for gi in range(n_grid)], axis=1), columns=names)
        t.insert(0, "fold", f)
        t.insert(1, "term_id", np.arange(size, dtype=np.int32))
        tables.append(t[(t[names] != 0).any(axis=1)])
    table = materialize(spark.createDataFrame(pd.concat(tables), "fold int, term_id int, " + ", ".join(f"{n} double" for n in names)), "grid_weights")
    terms = weighted.join(held, "row_id").join(table, ["fold", "term_id"])
    sums = terms.groupBy("row_id").agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])
    first = lambda gi, p: F.array(*[F.lit(fits[gi, f, p]["b"]) for f in range(k)])[F.col("fold")]
    margin = lambda gi, p: (F.coalesce(F.col(f"w{gi}_{p}"), F.lit(0.0)) + first(gi, p)).alias(f"s{p}")
    points = F.array(*[F.struct(F.lit(gi).alias("gi"), *[margin(gi, p) for p in range(n_pairs)]) for gi in range(n_grid)])
    return held.join(sums, "row_id", "left").select("row_id", "fold", "label", F.explode(points).alias("x")).select("row_id", "fold", "label", "x.*")


def grid_search(weighted: DataFrame, labels: DataFrame, size: int, Cs: list[float], k: int = 5, max_iter: int = 30,
                tol: float = 1e-2, parallelism: int = 8) -> tuple[DataFrame, dict]:
    """Stratified k-fold macro-F1 per C on ``labels`` (``row_id, label``) and
    a refit of the best C on all of them. Returns ``(C, gi, mean_score, is_best,
    max_iterations, converged)`` and ``{"C", "fits"}``."""
    spark = labels.sparkSession
    folds = materialize(stratified_kfold(labels, "row_id", k=k).select("row_id", "label", "fold"), "folds")
    # at most a row for each class and fold
    cells = {(r.label, r.fold): r.n for r in folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [{c: sum(n for (x, g), n in cells.items() if x == c and g != f) for c in LABELS} for f in [*range(k), None]]
    data = training_table(weighted, folds, size, sum(cells.values()))
    jobs = [(gi, f, p) for gi in range(len(Cs)) for f in range(k) for p in range(len(PAIRS))]

    def run(job):
        gi, f, p = job
        a, b = PAIRS[p]
        return fit_pair(data.filter(F.col("fold") != f), LABELS[a], LABELS[b], Cs[gi], counts[f], max_iter, tol)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        fits = dict(zip(jobs, pool.map(inheritable_thread_target(spark)(run), jobs)))
    margins = _held_out_margins(weighted, folds, fits, len(Cs), k, size)
    scored = materialize(ovo_vote(margins).withColumn("C", _of_grid(Cs)).select("gi", "C", "fold", "label", "prediction"), "grid_predictions")
    best = best_param(macro_f1(scored, ["gi", "C", "fold"]), "C", "gi")
    told = spark.createDataFrame([(gi, max(fits[gi, f, p]["iterations"] for f in range(k) for p in range(len(PAIRS))),
                                   all(fits[gi, f, p]["converged"] for f in range(k) for p in range(len(PAIRS)))) for gi in range(len(Cs))],
                                 "gi int, max_iterations int, converged boolean")
    res = materialize(best.join(told, "gi"), "grid_scores")
    C = res.filter("is_best").first()["C"]
    return res, {"C": C, "fits": fit_ovo(data, C, counts[k], max_iter, tol)}


def _of_grid(Cs: list[float]) -> Column:
    return F.array(*[F.lit(float(c)) for c in Cs])[F.col("gi")]


def train_classifier(labelled: DataFrame, Cs: list[float], k: int = 5, max_iter: int = 30,
                     fit_scope: str = "all", seed: int = 42, test_size: float = 0.2, tol: float = 1e-2):
    """I01-I05 end to end on ``(row_id, text, label)``: stratified split,
    TF-IDF (``fit_scope="all"`` fits the vocabulary on every labelled row as
    the reference does, leaking test terms into the idf; ``"train"`` fits it
    on the training rows only), stratified k-fold grid search over ``Cs`` on
    the training part, refit with the best C. Returns ``(model, split,
    grid_scores)``."""
    from ..operators.split import stratified_split
    spark = labelled.sparkSession
    split = materialize(stratified_split(labelled.select("row_id", "label"), "row_id", test_size=test_size, seed=seed), "split")
    tf, sums = tfidf.term_table(labelled, "row_id")
    fit_rows = labelled if fit_scope == "all" else split.filter(F.col("split") == "train")
    fit_tf = tf if fit_scope == "all" else tf.join(fit_rows.select("row_id"), "row_id", "left_semi")
    n_docs = fit_rows.agg(F.count(F.lit(1))).scalar()
    vocab = materialize(tfidf.fit_vocab(fit_tf, n_docs, sums=sums if fit_scope == "all" else None), "vocabulary")
    weighted = materialize(tfidf.transform(tf, vocab).select("row_id", "term_id", "weight"), "weights")
    train_rows = split.filter(F.col("split") == "train").select("row_id", "label")
    size = max(1, vocab.count())
    res, best = grid_search(weighted, train_rows, size, Cs, k, max_iter, tol)
    weights = weight_table(spark, best["fits"], size)
    return OvoModel(vocab, weights, [f["b"] for f in best["fits"]], best["C"]), split, res
