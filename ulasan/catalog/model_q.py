"""Model queries: grid-searched one-vs-one SVM, evaluation, save/load, and
the batch labeller run end to end (rows-only checks; see tests)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.labelling import label_job, publish
from ..operators.parallel import spread
from ..plans.evaluate import classification_report
from ..plans.svm import OvoModel, train_classifier
from ..session import scratch_path
from . import query
from .common import tbl
from .labels_q import GRID_C, SEED, label_col


def labelled_docs(spark, sf):
    lab = tbl(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), label_col().alias("label"))
    d = spread(tbl(spark, sf, "documents")).select(F.col("doc_id").alias("row_id"), "text")
    return d.join(lab, "row_id")


def train_model(spark, sf, Cs=None, k=5, max_iter=30, fit_scope="all"):
    """Train on the labelled documents of ``sf`` (see ``train_classifier``)."""
    ld = labelled_docs(spark, sf)
    model, split, res = train_classifier(ld, Cs or GRID_C, k=k, max_iter=max_iter, fit_scope=fit_scope, seed=SEED)
    return model, split, ld, res


@query("svm_grid_predict")
def svm_grid_predict_q(spark, sf):
    model, split, ld, _ = train_model(spark, sf)
    test = ld.join(split.filter(F.col("split") == "test").select("row_id"), "row_id")
    return test.select("row_id", "label").join(model.score(test, "row_id"), "row_id").select(
        F.col("row_id").alias("doc_id"), "label", "prediction", "symbol")


@query("evaluate_model")
def evaluate_model_q(spark, sf):
    return classification_report(svm_grid_predict_q(spark, sf))


@query("model_roundtrip")
def model_roundtrip_q(spark, sf):
    """Train on the whole grid, save, load and score every document."""
    model, _, _, _ = train_model(spark, sf)
    path = scratch_path(spark, "model")
    model.save(path)
    docs = spread(tbl(spark, sf, "documents")).select("doc_id", "text")
    return OvoModel.load(spark, path).score(docs, "doc_id").select(F.col("row_id").alias("doc_id"), "prediction", "symbol")


def offline_labeller(prompts, texts):
    """Deterministic stand-in for the remote labeller: a JSON array in the
    requested format, label from the text's length bucket."""
    out = []
    for ts in texts:
        items = [f'{{"index": {i}, "label": "{["negatif", "netral", "positif"][len(t) % 3]}"}}'
                 for i, t in enumerate(ts)]
        out.append("[" + ", ".join(items) + "]")
    return out


@query("label_batches", """
  SELECT d.doc_id, coalesce(l.label, CASE length(d.text) % 3 WHEN 0 THEN 'negatif' WHEN 1 THEN 'netral'
                                      ELSE 'positif' END) AS label
  FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'negatif' WHEN quality = 1 THEN 'positif'
                                                  ELSE 'netral' END AS label FROM labels) l USING (doc_id)""")
def label_batches_q(spark, sf):
    """Documents not yet in the state (seeded from ``labels``)
    are batched, prompted, labelled by the pluggable labeller, parsed and
    appended to the state; the published view has every document."""
    docs = spread(tbl(spark, sf, "documents")).select(F.col("doc_id").alias("row_id"), "text")
    state_path = scratch_path(spark, "label_state")
    tbl(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), label_col().alias("label"),
                                    F.lit(-1).cast("long").alias("batch_id"),
                                    F.current_timestamp().alias("labelled_at")) \
        .write.mode("append").parquet(state_path)
    label_job(docs, state_path, offline_labeller)
    return publish(docs.select("row_id"), spark.read.parquet(state_path)).select(
        F.col("row_id").alias("doc_id"), "label")
