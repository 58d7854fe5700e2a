"""Manual review: exact seeded sample and manual-over-automatic labels
(F05, G02, C07, M06)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import keep_first, order_key
from .split import seeded_key


def sample_exact(df: DataFrame, key: str, n: int = 300, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), chosen by the seeded md5 order.
    The limit is the sampling operator itself: a bounded top-n, planned as
    TakeOrderedAndProject (n rows per task, never the whole table)."""
    return df.orderBy(seeded_key(seed, key), F.col(key)).limit(n)


def override_labels(auto: DataFrame, manual: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Union both label sets, manual first; keep the first per key.
    A partial aggregate: no join, no per-key sort of the whole table."""
    both = (manual.select(key, label, F.lit(0).alias("prio"))
                  .unionByName(auto.select(key, label, F.lit(1).alias("prio"))))
    kept = keep_first(both, [key], order_key(F.col("prio")))
    return kept.select(key, label, (F.col("prio") == 0).alias("from_manual"))
