"""Structured Streaming jobs.

Every job writes through ``epochs.py``: an epoch that Spark runs again after a
failure replaces its own rows, so a restart neither repeats nor loses any.

J01 dedupe ingest: each micro-batch keeps the first row per key and drops keys
that earlier epochs hold. With a ``day`` column, which is the same in all copies
of a key, the sink is partitioned by it and only the batch's days are read.
J03 daily counts: windowed counts per keyword under a watermark. The state holds
the days that may still change; a batch writes the counts it changed. J02
scoring: lines from a text source are filtered and scored per micro-batch with a
model loaded once. Sinks and checkpoints live in the shared checkpoint folder.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_ws

from ..operators.dedupe import keep_first
from .epochs import read_epochs, write_epoch

SENTINELS = ["exit", "quit", "keluar"]   # fixed value: words that end the line loop


def _start(stream: DataFrame, batch, checkpoint: str, trigger: dict | None, mode: str = "append"):
    return (stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
                  .trigger(**(trigger or {"availableNow": True})).start())


def _earlier(df: DataFrame, key: str, sink: str, epoch: int, day: str | None) -> DataFrame | None:
    """The keys that epochs before this one wrote, of the batch's days only."""
    spark, before = df.sparkSession, F.col("epoch") < epoch
    if day is None:
        seen = read_epochs(spark, sink, before)
    else:
        first, last, unknown = df.agg(F.min(day), F.max(day), F.max(F.col(day).isNull())).first()
        of_days = F.col(day).between(F.lit(first), F.lit(last))
        if unknown:
            of_days = of_days | F.col(day).isNull()
        seen = read_epochs(spark, sink, before & F.coalesce(of_days, F.lit(False)))
    return None if seen is None else seen.select(key)


def dedupe_ingest(stream: DataFrame, key: str, order: Column, sink: str, checkpoint: str,
                  trigger: dict | None = None, day: str | None = None):
    """J01, exact: one row per key over all batches and restarts. ``day`` names a
    date column that is the same in all copies of a key; what a batch reads of
    the sink is then bounded by its days, not by the sink. Without it the sink's
    keys are read whole."""
    def batch(df: DataFrame, epoch: int):
        df = df.persist()                # its days are asked for first
        try:
            new, seen = keep_first(df, [key], order), _earlier(df, key, sink, epoch, day)
            if seen is not None:
                new = new.join(seen, key, "left_anti")
            write_epoch(new, sink, epoch, [day] if day else None)
        finally:
            df.unpersist()

    return _start(stream, batch, checkpoint, trigger)


def read_ingested(spark: SparkSession, sink: str) -> DataFrame | None:
    """The rows of the dedupe sink."""
    rows = read_epochs(spark, sink)
    return None if rows is None else rows.drop("epoch")


def dedupe_within_watermark(stream: DataFrame, key: str, ts: str, delay: str, sink: str,
                            checkpoint: str, trigger: dict | None = None):
    """J01, bounded-state variant: a key seen again within ``delay`` of event
    time is dropped; state older than the watermark is evicted. Use when the
    copies of a key differ in their day and late duplicates beyond ``delay`` are
    acceptable."""
    d = (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
               .dropDuplicatesWithinWatermark([key]))
    return (d.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def daily_counts(stream: DataFrame, ts: str, key: str, sink: str, checkpoint: str,
                 trigger: dict | None = None, delay: str = "2 days"):
    """Rows that come up to ``delay`` behind the newest are counted; days
    older than that leave the state and stay in the sink as they are."""
    counts = (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
                    .groupBy(F.window(ts, "1 day").alias("w"), F.col(key))
                    .agg(F.count(F.lit(1)).alias("n")))

    def batch(df: DataFrame, epoch: int):
        write_epoch(df.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), key, "n"), sink, epoch)

    return _start(counts, batch, checkpoint, trigger, "update")


def read_daily(spark: SparkSession, sink: str, key: str) -> DataFrame | None:
    """``(day, key, n)``: the newest count of every day and key."""
    rows = read_epochs(spark, sink)
    return None if rows is None else rows.groupBy("day", key).agg(F.max_by("n", "epoch").alias("n"))


def keep_line(c: Column) -> Column:
    """Drop blank lines and the exit words (case-insensitive)."""
    t = strip_ws(c)
    return (t != "") & ~F.lower(t).isin(SENTINELS)


def score_epoch(df: DataFrame, epoch: int, predict, sink: str) -> None:
    """J02, one epoch: its lines with their predictions, replaced whole when it
    is run again."""
    rows = df.filter(keep_line(F.col("value"))).select(
        F.monotonically_increasing_id().alias("row_id"), strip_ws("value").alias("text")).persist()   # ids are read twice
    try:
        write_epoch(rows.join(predict(rows), "row_id").select("text", "prediction"), sink, epoch)
    finally:
        rows.unpersist()


def score_stream(lines: DataFrame, predict, sink: str, checkpoint: str, trigger: dict | None = None):
    """``predict(df with row_id, text) -> (row_id, prediction)``; read the sink
    with ``read_scored``."""
    return _start(lines, lambda df, epoch: score_epoch(df, epoch, predict, sink), checkpoint, trigger)


def read_scored(spark: SparkSession, sink: str) -> DataFrame | None:
    """``(text, prediction)`` of all committed epochs."""
    rows = read_epochs(spark, sink)
    return None if rows is None else rows.select("text", "prediction")
