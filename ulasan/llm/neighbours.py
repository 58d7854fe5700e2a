"""Approximate nearest neighbours by multi-index hashing (operator 5).

- Codes: vectors are centred, rotated and cut at zero, one bit a dimension. The
  rotation is learned on a bounded sample (``SAMPLE`` rows by hash): principal
  axes, then alternating updates that bring the rotated vectors near their
  codes.
- Index: codes are cut into substrings of 8 bits. Each index block lists its
  rows by the value of every substring.
- Probing: if two codes of m substrings differ in at most r bits, some
  substring differs in at most ``floor(r / m)``. So a query probes, in every
  substring, all values within that distance, which retrieves every code
  within r bits; the exact distance of the retrieved codes is then checked.
- Widening: a query that retrieves fewer than ``k`` rows in all blocks, as one
  far from the rest does, is asked again at a wider radius, up to all bits, where
  every row is retrieved.
- Reranking: the retrieved rows are ranked by Euclidean distance of the
  original vectors in double precision.

The radius is learned with the rotation: it covers the share ``COVER`` of the
sample's true neighbours (of ``NEIGHBOURS`` in the sample; a larger table has
nearer ones). Where the vectors have no structure, that radius is wide and
probing reads a good part of the index: such data have no better answer.

Queries and index rows are dealt to blocks of bounded size by hash of the id,
and every query block meets every index block in one bounded task, which
returns at most ``k`` rows for each query. Blocks do not depend on the vectors,
so thousands of equal vectors are no hot spot.

Edge cases: vectors that are NULL, zero, or hold NULL or non-finite components
take no part, nor do rows without an id, nor vectors of another length than the
most frequent one. If an id has several vectors, its smallest one counts. With
fewer candidates than ``k``, all are returned. An empty table,
or one without queries, gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

NEIGHBOURS = 10
SAMPLE = 4096
SAMPLE_QUERIES = 256
COVER = 0.985
ROUNDS = 30
QUERY_BLOCK = 2048
INDEX_BLOCK = 16384
_POP = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)


class Rotation:
    """Centre, rotation and probing radius, learned on a sample."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        n, d = sample.shape
        self.centre = sample.mean(0)
        x = sample - self.centre
        axes = np.linalg.svd(x, full_matrices=True)[2].T if n > 1 else np.eye(d)
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
        y = x @ axes
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ vt).T
        self.turn = axes @ turn
        codes = self.codes(sample)
        self.substrings = codes.shape[1]
        bits = []
        for i in range(min(n, SAMPLE_QUERIES)):
            far = ((sample - sample[i]) ** 2).sum(1)
            far[i] = np.inf
            near = np.argsort(far, kind="stable")[:min(NEIGHBOURS, n - 1)]
            bits += _POP[codes[near] ^ codes[i]].sum(1).tolist()
        self.radius = int(np.ceil(np.quantile(bits, COVER))) if bits else d

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.turn > 0, axis=1)


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(vec_id, v)``: one row an id, only vectors that take part."""
    v = F.col(vector).cast("array<double>")
    good = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def search_block(rotation: Rotation, q_ids, q, ids, x, k: int, radius: int | None = None) -> list[tuple[int, int, float]]:
    """The ``k`` nearest retrieved rows of each query in one index block."""
    q_code, code = rotation.codes(q), rotation.codes(x)
    m = rotation.substrings
    radius = rotation.radius if radius is None else radius
    reach = radius // m
    near = _POP[np.arange(256)[:, None] ^ np.arange(256)] <= reach        # values to probe
    lists = []                                                             # substring index: rows by value
    for j in range(m):
        order = np.argsort(code[:, j], kind="stable")
        lists.append((order, np.bincount(code[:, j], minlength=256)))
    out = []
    for a in range(len(q)):
        seen = np.zeros(len(x), dtype=bool)
        for j, (order, count) in enumerate(lists):
            seen[order[np.repeat(near[q_code[a, j]], count)]] = True
        rows = np.flatnonzero(seen)
        rows = rows[_POP[code[rows] ^ q_code[a]].sum(1, dtype=np.int64) <= radius]
        rows = rows[ids[rows] != q_ids[a]]
        d = np.sqrt(((x[rows] - q[a]) ** 2).sum(1))
        if len(rows) > k:
            few = d <= np.partition(d, k - 1)[k - 1]
            rows, d = rows[few], d[few]
        best = np.lexsort((ids[rows], d))[:k]
        out += [(int(q_ids[a]), int(ids[rows[b]]), float(d[b])) for b in best]
    return out


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the ids divisible by ``every``."""
    spark = vectors.sparkSession
    good = usable(vectors, id_column, vector)
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    dim, n = (lengths[0]["d"], lengths[0]["n"]) if lengths else (0, 0)
    rows = materialize(good.where(F.size("v") == dim), "neighbours")
    share = min(1.0, 2 * SAMPLE / max(1, n))      # few rows leave each task, however many tasks there are
    sample = (rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
              .orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect())         # SAMPLE rows at most
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotation = spark.sparkContext.broadcast(Rotation(np.array([r["v"] for r in sample])))
    q_blocks, i_blocks = max(1, -(-n // (every * QUERY_BLOCK))), max(1, -(-n // INDEX_BLOCK))
    dealt = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.where(F.col("vec_id") % every == 0)
    index = rows.select(all_of(q_blocks).alias("qb"), dealt(i_blocks).cast("int").alias("ib"), "vec_id", "v")

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("vec_id").to_numpy()
        return ids, t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)

    def search(queries: DataFrame, radius: int) -> DataFrame:
        def run(q: pa.Table, x: pa.Table) -> pa.Table:
            found = search_block(rotation.value, *arrays(q), *arrays(x), k, radius) if q.num_rows and x.num_rows else []
            return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()),
                             "score": pa.array([f[2] for f in found], pa.float64())})

        q = queries.select(dealt(q_blocks).cast("int").alias("qb"), all_of(i_blocks).alias("ib"), "vec_id", "v")
        found = q.groupBy("qb", "ib").cogroup(index.groupBy("qb", "ib")).applyInArrow(run, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                           .select("query_id", "rank", "vec_id", "score"), "neighbours")

    # a query that stands apart finds too few rows at the common radius: it is asked again at wider ones, up to all bits
    need, bits, radius = min(k, n - 1), 8 * rotation.value.substrings, rotation.value.radius
    out, done = [], search(asked, radius)
    while radius < bits:
        full = done.where(F.col("rank") == need).select(F.col("query_id").alias("vec_id"))
        short = asked.join(full, "vec_id", "left_anti")
        if need < 1 or short.isEmpty():
            break
        out.append(done.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi"))
        radius = min(bits, radius + max(8, radius // 2))
        asked = materialize(short, "neighbours")
        done = search(asked, radius)
    for more in out:
        done = done.unionByName(more)
    return done.select("query_id", "rank", "vec_id", "score")
