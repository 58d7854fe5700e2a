"""Positional numbering (E02) without a single-partition window.

A global ``row_number()`` funnels every row through one task. Instead the rows
are range-partitioned and sorted on the total order, each partition counts its
rows, the (tiny: one row per partition) count table is prefix-summed and
broadcast back. The tagged rows are checkpointed to the shared checkpoint
folder first so both passes see identical partitions even if executors are
lost (range-partition sampling is not stable across separate executions).

Only the columns to keep and those of the order go through the range shuffle, and
the number of ranges follows the number of rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


#: Rows of a range: of slim rows, some hundred MB in one task at most.
ROWS_PER_RANGE = 2_000_000


def with_positions(df: DataFrame, order: list[Column], name: str = "pos",
                   num_partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with each row's 0-based position in the total ``order``. ``keep``:
    the columns of the result besides the position (None: all); name the key
    alone where rows are wide and join the rest on it afterwards."""
    spark = df.sparkSession
    keep = df.columns if keep is None else keep
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_RANGE))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = materialize(ordered.select(*keep, F.spark_partition_id().alias("__pid"),
                                        F.monotonically_increasing_id().alias("__mid")), "positions")
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"),
                                         F.min("__mid").alias("__m0"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = tagged.join(F.broadcast(offsets.select("__pid", "__m0", "__off")), "__pid")
    return (out.withColumn(name, (F.col("__off") + F.col("__mid") - F.col("__m0")).cast("long"))
               .drop("__pid", "__mid", "__m0", "__off"))
