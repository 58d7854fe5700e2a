"""Parallelism guard for CPU-heavy text work.

A cluster scan already yields one task per file split; a single small file
(one Parquet row group) yields one task for the whole table. ``spread`` only
repartitions when the input has fewer partitions than the cluster has cores,
so it is a no-op at scale and avoids a one-core regex pass on small inputs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_parts: int | None = None) -> DataFrame:
    """Use on file scans only: on a plan that already shuffles, AQE would
    have to run the shuffle to know its final partition count."""
    try:
        sc = df.sparkSession.sparkContext
        target = min_parts or sc.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:   # noqa: BLE001  (no RDD view, e.g. a remote session)
        return df
    return df.repartition(target)
