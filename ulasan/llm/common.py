"""Shared by the operators: session settings and Arrow column access."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Rows in one Arrow batch: whole texts travel in them, some of them very long.
ROWS_PER_BATCH = 256


def prepare(spark: SparkSession) -> None:
    """Settings the operators rely on: UTC, a shared checkpoint folder, this
    package on the executors, and Arrow batches that stay small in bytes."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text"):
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column without NULLs; text i
    is ``bytes[offsets[i]:offsets[i + 1]]``. No copy of the text is made."""
    col = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]
