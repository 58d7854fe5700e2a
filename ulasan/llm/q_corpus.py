"""Queries on secrets (4), neighbours (5), quality (8) and shards (10)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .neighbours import nearest
from .quality import THRESHOLD, score_statistics, train
from .registry import query
from .secret_scan import listed, secret_spans
from .sharding import MAX_BYTES, shard


@query("op4_secret_scan")
def op4(spark, sf_dir: str) -> DataFrame:
    """Base spans and linked weak candidates of every whole document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


OP10_SQL = f"""
WITH r AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
p AS (SELECT r.*, d::INTEGER AS depth, h >> (60 - d) AS prefix FROM r, range(0, 41) t(d)),
n AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL)
SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, depth, shard_bytes, shard_rows
FROM p JOIN n USING (depth, prefix)
WHERE shard_bytes <= {MAX_BYTES} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY depth) = 1
"""


@query("op10_sharding", OP10_SQL)
def op10(spark, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard(table(spark, sf_dir, "documents"))


@query("op5_nearest_neighbours")
def op5(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op8_quality_classifier")
def op8(spark, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    stats, model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_statistics(stats, model).select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
