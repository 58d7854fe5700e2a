"""Corpus build: merge (M01) and clean.

Both are one lazy plan from scan to sink. The only exchanges are the keep-first
aggregation on the text (partially aggregated, so hot duplicate texts shrink on
the map side) and, only when the caller asks for it, the final range sort.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_and_filter, strip_ws
from ..operators.dedupe import keep_first, nulls_first, order_key
from ..sources.registry import SourceSpec, scan_sources

MIN_WORDS = 2
MIN_CHARS = 5


def merged_order():
    """Keep-first order of the merge: config order of sources, then row order."""
    return order_key(F.col("source_rank"), F.col("row_key"))


def corpus_order():
    """Order of the merged corpus (F01): null dates first, then date, source, row."""
    return order_key(*nulls_first(F.col("date")), F.col("source_rank"), F.col("row_key"))


def merge_sources(spark: SparkSession, specs: list[SourceSpec]) -> DataFrame:
    """Union in config order, drop null text, strip, keep first per text.
    Returns ``text, date, source, source_rank, row_key`` (unsorted)."""
    u = scan_sources(spark, specs)
    u = u.filter(F.col("text").isNotNull()).withColumn("text", strip_ws("text"))
    return keep_first(u, ["text"], merged_order())


def sort_corpus(df: DataFrame) -> DataFrame:
    """date ascending with nulls first; ties by source rank and row."""
    return df.orderBy(F.col("date").asc_nulls_first(), "source_rank", "row_key")


def clean_corpus(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS,
                 min_chars: int = MIN_CHARS, order=None,
                 observation: Observation | None = None) -> DataFrame:
    """Clean every text, drop blank and short texts, keep first per text.

    ``order`` defaults to the merged corpus order. An ``Observation`` collects
    the before/after row counts in the same pass (D06)."""
    d = df
    if observation is not None:
        d = d.observe(observation, F.count(F.lit(1)).alias("rows_before"))
    d = clean_and_filter(d, text, min_words, min_chars)
    return keep_first(d, [text], order if order is not None else corpus_order())


def build_corpus(spark: SparkSession, specs: list[SourceSpec], merged_path: str, cleaned_path: str) -> dict:
    """M01 + M02 as a job: write the merged table and the cleaned table
    (A06) and report rows before/after per stage (D06) from an Observation
    collected in the same pass as the write."""
    merged = merge_sources(spark, specs)
    merged.write.mode("overwrite").parquet(merged_path)
    m = spark.read.parquet(merged_path)
    obs = Observation("clean")
    cleaned = clean_corpus(m, observation=obs)
    cleaned.write.mode("overwrite").parquet(cleaned_path)
    before = obs.get["rows_before"]
    after = spark.read.parquet(cleaned_path).count()
    return {"rows_before": before, "rows_after": after, "removed": before - after}
