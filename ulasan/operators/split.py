"""Stratified split, stratified k-fold and class weights.

Per-class ranks come from range-partitioned positions on ``(label, key)``
minus the class start (never a per-class window, which would put a class that
holds a third of all rows into one task). Class sizes are a tiny table
(one row per class) joined back by broadcast.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import with_positions


def seeded_key(seed: int, key: str) -> Column:
    """Engine-independent pseudo-random order: md5 of ``'seed:key'``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n_c, start)``: class counts and where each class starts in
    label order (small table: one row per class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("start", F.coalesce(F.sum("n_c").over(w), F.lit(0)).cast("long"))


def rank_in_class(df: DataFrame, order: list[Column], label: str = "label", name: str = "rk") -> DataFrame:
    """0-based rank of each row inside its class under ``order``."""
    sizes = class_sizes(df, label)
    p = with_positions(df, [F.col(label)] + order, "__gpos")
    return (p.join(F.broadcast(sizes), label)
             .withColumn(name, F.col("__gpos") - F.col("start")).drop("__gpos"))


def split_sizes(df: DataFrame, label: str = "label", test_size: float = 0.2) -> DataFrame:
    """n_test = ceil(test_size·n); per class floor(n_c·n_test/n), the
    leftover rows go to the largest fractional parts (ties: label order)."""
    s = class_sizes(df, label)
    everyone = Window.partitionBy()
    s = (s.withColumn("n", F.sum("n_c").over(everyone))
          .withColumn("n_test_all", F.ceil(F.col("n") * F.lit(test_size)).cast("long"))
          .withColumn("parts", F.col("n_c").cast("decimal(19,0)") * F.col("n_test_all").cast("decimal(19,0)"))
          .withColumn("base", F.expr("parts div n"))
          .withColumn("frac", F.col("parts") % F.col("n"))
          .withColumn("left", F.col("n_test_all") - F.sum("base").over(everyone))
          .withColumn("frac_rank", F.row_number().over(Window.orderBy(F.desc("frac"), F.col(label))))
          .withColumn("n_test", F.col("base") + F.when(F.col("frac_rank") <= F.col("left"), 1).otherwise(0)))
    return s.select(label, F.col("n_c").alias("n"), F.col("n_test").cast("long").alias("n_test"),
                    (F.col("n_c") - F.col("n_test")).cast("long").alias("n_train"))


def stratified_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact per-class test counts; rows chosen by the seeded md5 order."""
    sizes = split_sizes(df, label, test_size).select(label, "n_test")
    r = rank_in_class(df, [seeded_key(seed, key), F.col(key)], label)
    return (r.join(F.broadcast(sizes), label)
             .withColumn("split", F.when(F.col("rk") < F.col("n_test"), "test").otherwise("train"))
             .drop("rk", "n_test", "n_c", "start"))


def stratified_kfold(df: DataFrame, key: str, label: str = "label", k: int = 5) -> DataFrame:
    """Unshuffled stratified k-fold in row order (``key``), the same fold
    sizes as the usual rule: labels sorted, position p of the sorted label
    vector goes to fold p mod k; each class fills its folds in row order."""
    sizes = class_sizes(df, label)
    a, b = F.col("start"), F.col("start") + F.col("n_c")

    def count_mod(i):   # positions p in [a, b) with p mod k == i
        return (F.floor((b - 1 - i) / k) - F.floor((a - 1 - i) / k)).cast("long")

    cum = [count_mod(0)]
    for i in range(1, k):
        cum.append(cum[-1] + count_mod(i))
    bounds = sizes.select(label, *[c.alias(f"__c{i}") for i, c in enumerate(cum)])
    r = rank_in_class(df, [F.col(key)], label).drop("n_c", "start")
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        fold = F.when(F.col("rk") < F.col(f"__c{i}"), F.lit(i)).otherwise(fold)
    out = r.join(F.broadcast(bounds), label).withColumn("fold", fold.cast("int"))
    return out.drop("rk", *[f"__c{i}" for i in range(k)])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k · n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    everyone = Window.partitionBy()
    return c.withColumn("weight", F.sum("n_c").over(everyone) / (F.count(F.lit(1)).over(everyone) * F.col("n_c")))
