"""A table written by the epochs of a stream, with a commit for each of them.

``foreachBatch`` is called again for an epoch whose end Spark could not record.
An epoch's rows go to a folder of their own, and one row in the commit log, the
last thing written, makes them visible. Written again, an epoch is replaced
whole: the newest commit of an epoch counts. Readers see committed epochs only,
never half an epoch and never two versions of one.

Layout: ``data/epoch=N/attempt=A[/day=D]`` and ``commits`` (``epoch, attempt, at``).
"""
from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.registry import read_table

COMMITS = "epoch long, attempt string, at long"


def write_epoch(df: DataFrame, path: str, epoch: int, partition_by: list[str] | None = None) -> None:
    """Write ``df`` as the rows of ``epoch`` and commit it."""
    attempt = uuid.uuid4().hex
    rows = df.withColumns({"epoch": F.lit(epoch).cast("long"), "attempt": F.lit(attempt)})
    rows.write.mode("append").partitionBy("epoch", "attempt", *(partition_by or [])).parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(epoch, attempt, time.time_ns())], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """``(epoch, attempt)``: the newest committed attempt of every epoch."""
    log = read_table(spark, f"{path}/commits", schema=COMMITS)
    return None if log is None else log.groupBy("epoch").agg(F.max_by("attempt", "at").alias("attempt"))


def read_epochs(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame | None:
    """The rows of all committed epochs with ``epoch``; ``None`` when there is no
    data. ``where`` may prune partition columns before anything is read."""
    log, data = committed(spark, path), read_table(spark, f"{path}/data")
    if log is None or data is None:
        return None
    if where is not None:
        data = data.where(where)
    data = data.withColumn("epoch", F.col("epoch").cast("long"))
    return data.join(log, ["epoch", "attempt"]).drop("attempt")
