"""CSV sinks and sources with the quoting the reference's files need (A01,
A05, A06): RFC-4180 doubled quotes, quoted newlines, header row."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A06 (overwrite) / A05 (append; every part file carries its header)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A01 with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
