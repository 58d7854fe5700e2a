"""Quality classifier (operator 8): random Fourier features of document
statistics, ridge regression by partition-summed normal equations, isotonic
calibration.

1. Every whole text gives some twenty statistics (lengths, shares of character
   classes, repetition of words and lines). Neither labels nor lang, source or
   doc_id enter them.
2. The statistics are standardised, clipped, and mapped to ``FEATURES`` random
   cosines whose inner products approximate a Gaussian kernel (fixed seed).
3. Ridge weights come from the normal equations: each partition sums its
   Z'Z and Z'y, and the sums are added. Learning uses at most
   ``MAX_FIT_ROWS`` labelled rows (a seeded sample by hash, the same bound at
   every size), in partitions of ``FIT_PARTITION_ROWS``, so the driver adds a
   bounded number of small matrices.
4. Rows that the ridge fit did not see calibrate the scores: they are counted
   by bins of the raw score, adjacent violators are pooled, and scores between
   the pools are interpolated. A hundredth of the raw score is mixed in, so that
   pooled scores keep their order.

Folds are ``crc32(doc_id as text) % 5``: 0 is held out, 1-3 fit, 4 calibrates.

Edge cases: a NULL text counts as empty and is scored like any other; a NULL
doc_id belongs to the held-out fold. Labels other than 0 and 1 are ignored, and
a document with several labels takes their mean. Without labels of both classes
every score is 0.5. Repeated rows are scored each. An empty table gives an
empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import whole_text

FEATURES = 256
RIDGE = 1e-3
MAX_FIT_ROWS = 200_000
FIT_PARTITION_ROWS = 20_000
THRESHOLD = 0.3
SEED = 20240229
BINS = 2000
STATISTICS = 20

_CLASS = np.zeros(256, dtype=np.int64)          # other control characters
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[128:] = 8


def statistics(text: str) -> list[float]:
    """The statistics of one text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    size = max(1, len(raw))
    share = (np.bincount(raw, minlength=256) @ np.eye(9)[_CLASS]) / size
    words = text.split()
    n = max(1, len(words))
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    lengths = [len(w) for w in words] or [0]
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(lengths) / n, math.log1p(max(lengths)),
        share[1], share[2], share[3], share[4], share[6], share[7], share[8], share[0],
        again / n, math.log1p(distinct) / math.log1p(n), sum(map(str.isupper, words)) / n,
        sum(1 for w in words if not w[-1].isalnum()) / n, sum(1 for w in words if not any(map(str.isalnum, w[:8]))) / n,
        math.log1p(len(lines)), len(set(lines)) / k, math.log1p(len(text) / k),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, fold, x)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "fold", "x"])

    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, fold int, x array<double>")


class Model:
    """Standardisation, projection, ridge weights and calibration: a few arrays
    of fixed size."""

    def __init__(self, mean, scale, weights=None, knots=None):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.project = rng.standard_normal((STATISTICS, FEATURES)) / math.sqrt(STATISTICS)
        self.phase = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights, self.knots = weights, knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.cos(z @ self.project + self.phase) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        r = self.raw(x)
        return 0.99 * np.interp(r, *self.knots) + 0.01 * (r + 1) / 3


def pool(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: block means, and the
    block of each value."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.array([b[0] for b in blocks]), np.repeat(np.arange(len(blocks)), [b[2] for b in blocks])


def _sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist()))
                total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])
    return run


def _binned(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(((raw + 1) / 3 * BINS).astype(np.int32)), pa.array(raw), batch.column(1)], names=["bin", "raw", "y"])
    return run


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Model:
    """Learn from the labelled rows of folds 1 to 4."""
    y = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("__id"))
         .agg(F.avg(label).cast("double").alias("y")))
    rows = stats.where("fold <> 0").join(y, F.col("doc_id") == F.col("__id")).select("doc_id", "fold", "x", "y")
    n = rows.groupBy((F.col("fold") == 4).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
    n = {r["c"]: r for r in n}
    if False not in n or n[False]["lo"] == n[False]["hi"]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    total = sum(r["n"] for r in n.values())
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    rows = materialize(rows.repartition(max(1, -(-min(total, max_rows) // FIT_PARTITION_ROWS)), "doc_id"), "quality-fit")
    fit_rows = rows.where("fold <> 4")
    moments = fit_rows.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    scale = [max(moments[2 * i + 1], 1e-6) for i in range(STATISTICS)]
    model = Model([moments[2 * i] for i in range(STATISTICS)], scale)
    parts = fit_rows.select("x", "y").mapInArrow(_sums(model), "sums binary").collect()     # one small matrix a partition
    total = np.sum([np.frombuffer(r["sums"]).reshape(FEATURES + 1, FEATURES + 2) for r in parts], axis=0)
    gram, moment = total[:, :-1], total[:, -1]
    model.weights = np.linalg.solve(gram + RIDGE * gram[-1, -1] * np.diag([1.0] * FEATURES + [1e-9]), moment)
    source = rows.where("fold = 4") if True in n else fit_rows
    bins = source.select("x", "y").mapInArrow(_binned(model), "bin int, raw double, y double").groupBy("bin").agg(
        F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    raw, mean, weight = (np.array([float(r[c]) for r in bins]) for c in ("raw", "y", "n"))
    levels, block = pool(mean, weight)
    centre = np.array([np.average(raw[block == b], weights=weight[block == b]) for b in range(len(levels))])
    model.knots = (centre, levels)
    return model


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, fold, score)``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)      # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = shared.value.score(np.array(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["doc_id", "fold", "score"])

    return stats.mapInArrow(run, "doc_id long, fold int, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose whole text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                s = shared.value.score(np.array([statistics(t or "") for t in texts]))
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """The statistics table of all documents, and the model."""
    stats = materialize(document_statistics(docs), "quality")
    return stats, fit(stats, labels)
