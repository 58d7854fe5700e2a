"""Counts and distributions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """pandas ``value_counts``: nulls excluded, most frequent first (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.desc(name), F.col(col)))


def zero_filled_counts(df: DataFrame, col: str, domain: list[str], name: str = "n") -> DataFrame:
    """Counts for every value of a fixed domain, 0 when absent, with its order.
    The domain is a short literal list, so it is broadcast."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"ord int, {col} string")
    cnt = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return (F.broadcast(dom).join(cnt, col, "left")
              .select("ord", col, F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)))


def with_share(counts: DataFrame, name: str = "n", out: str = "share", digits: int = 6) -> DataFrame:
    """Share of the total (D07); the total is a scalar aggregate, so the
    count table may be of any size."""
    tot = counts.agg(F.sum(name)).scalar()
    return counts.withColumn(out, F.round(F.col(name) / tot, digits))


def word_counts(docs: DataFrame, text_col: str = "text", stop_words=()) -> DataFrame:
    """D20 word counts: ``\\w[\\w']*`` tokens, lower-cased, trailing "'s"
    dropped, pure numbers and ``stop_words`` removed; partially aggregated."""
    from ..functions.patterns import WORD
    w = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(f"{WORD}[\\p{{L}}\\p{{N}}_']*"), 0))
                    .alias("x"))
    w = w.select(F.when(F.col("x").endswith("'s"), F.expr("substring(x, 1, length(x) - 2)"))
                  .otherwise(F.col("x")).alias("word"))
    w = w.filter(~F.col("word").isin(list(stop_words)) & ~F.col("word").rlike("^[0-9]+$") & (F.col("word") != ""))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_frequencies(docs: DataFrame, text_col: str = "text", n: int = 80, stop_words=()) -> DataFrame:
    """The ``n`` most frequent words (ties: word) with the relative
    frequency ``n / max(n)`` used for word-cloud sizing."""
    from ..plans.tfidf import top_terms
    top = top_terms(word_counts(docs, text_col, stop_words).withColumnRenamed("word", "term"), n)
    mx = top.agg(F.max("n")).scalar()
    return top.select(F.col("term").alias("word"), "n", F.round(F.col("n") / mx, 6).alias("rel"))
