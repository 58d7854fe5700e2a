"""Keep-first deduplication.

``keep_first(df, keys, order)`` keeps, for every distinct ``keys`` value, the
row that is smallest under the total ``order``. It is an aggregation, not a
window: ``min_by`` is partially aggregated on the map side, so a key that
holds a third of all rows collapses to one row per map task before the
shuffle. A 64-bit hash of the keys leads the grouping keys so the sort-based
aggregate sorts on a long prefix (radix sort) instead of comparing long texts;
the real keys follow, so the result stays exact under hash collisions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(*parts: Column) -> Column:
    """Struct usable as a total order: each part must be non-null or wrapped
    with ``nulls_first``/``nulls_last``."""
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def nulls_first(c: Column) -> list[Column]:
    return [F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1)), c]


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    cols = df.columns
    h = "__kf_hash"
    rest = [c for c in cols if c not in keys]
    payload = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(1)
    agg = (df.groupBy(F.xxhash64(*keys).alias(h), *[F.col(k) for k in keys])
             .agg(F.min_by(payload, order).alias("__kf_row")))
    return agg.select(*[F.col(k) for k in keys],
                      *[F.col("__kf_row")[c].alias(c) for c in rest]).select(*cols)
