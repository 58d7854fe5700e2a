"""TF-IDF over word uni+bigrams.

Semantics: lower-cased tokens of ≥ 2 word characters, uni+bigrams, the
``max_features`` most frequent terms over the corpus (ties: term order),
idf = ln((1+n)/(1+df)) + 1, tf = 1 + ln(count), rows L2-normalised over the
kept terms. Term ids follow term order.

Plan: Spark cuts the tokens; a task counts the terms of its documents batch by
batch on numbers (a word or pair of words of the batch each), so the corpus is
never shuffled as tokens. For the vocabulary every term adds its count to one of
``BUCKETS`` hash buckets, in the same pass; only terms of buckets at least as heavy
as the k-th term are counted by name, all others are certain to lie below it. Terms
meet the vocabulary by a 64-bit hash, then by themselves. The top-k is cut
at a count threshold found from a histogram of counts (one row per distinct
count), so the final sort only sees the candidates. The vocabulary is bounded by
``max_features`` and broadcast; the L2 norm is a window on ``row_id`` over
the in-vocabulary terms only.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import materialize, ship_package

MAX_FEATURES = 10_000
BUCKETS = 1 << 20      # hash buckets of term counts, 8 MB in a task
TOKENS_AT_ONCE = 1 << 20
HEAVY = 4              # buckets counted by name at first, for each term wanted


def _chunks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of rows with ``most`` tokens at most (a longer row alone)."""
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _count_terms(batches, pairs: bool, buckets: bool):
    """``(row_id, term, tf)`` of batches ``(row_id, words)``. With ``buckets`` the
    occurrences of every bucket follow as rows ``(NULL, NULL, n, bucket)``."""
    sums = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _chunks(lengths, TOKENS_AT_ONCE):
            part, n = batch.slice(a, b - a), lengths[a:b]
            coded = part.column(1).flatten().dictionary_encode()
            if not len(coded):
                continue
            words, code, row = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(b - a), n)
            # a term as a number: its first word, then 0 or 1 + its second one
            base = len(words) + 1
            key = code * base
            if pairs:
                near = row[1:] == row[:-1]
                key, row = np.concatenate([key, (key[:-1] + code[1:] + 1)[near]]), np.concatenate([row, row[1:][near]])
            key, at = np.unique(key, return_inverse=True)
            first, second = key // base, key % base
            if buckets:
                crc = np.array([0] + [zlib.crc32(w.encode()) for w in words.to_pylist()], np.int64)
                np.add.at(sums, (crc[first + 1] * 31 + crc[second]) & (BUCKETS - 1), np.bincount(at))
            cell, tf = np.unique(row * len(key) + at, return_counts=True)
            one = words.take(pa.array(first))
            both = pc.binary_join_element_wise(one, words.take(pa.array(second - 1, mask=second == 0)), " ")
            terms = pc.coalesce(both, one)
            for i in range(0, len(cell), TOKENS_AT_ONCE):
                c = cell[i:i + TOKENS_AT_ONCE]
                yield _batch(part.column(0).take(pa.array(c // len(key))), terms.take(pa.array(c % len(key))),
                             pa.array(tf[i:i + TOKENS_AT_ONCE]), pa.nulls(len(c), pa.int32()) if buckets else None)
    if sums.any():
        at = np.flatnonzero(sums)
        yield _batch(pa.nulls(len(at), batch.column(0).type), pa.nulls(len(at), pa.string()), pa.array(sums[at]), pa.array(at.astype(np.int32)))


def _batch(row_id, term, tf, bucket) -> pa.RecordBatch:
    columns = {"row_id": row_id, "term": term, "tf": tf, "bucket": bucket}
    return pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if v is not None})


def _terms(docs: DataFrame, id_col: str, words: Column, pairs: bool, buckets: bool) -> DataFrame:
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("row_id"), words.alias("words"))
    fields = [T.StructField("row_id", d.schema["row_id"].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    if buckets:
        fields.append(T.StructField("bucket", T.IntegerType()))
    return d.mapInArrow(lambda batches: _count_terms(batches, pairs, buckets), T.StructType(fields))


def doc_terms(docs: DataFrame, id_col: str, text_col: str = "text",
              terms: Column | None = None) -> DataFrame:
    """``(row_id, term, tf)``, one row per distinct term of a document: its uni-
    and bigrams, or the strings of the array ``terms``."""
    words = tokens(F.col(text_col)) if terms is None else F.array_compact(terms)
    return _terms(docs, id_col, words, terms is None, False)


def term_table(docs: DataFrame, id_col: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_terms`` as a written table and the ``bucket_sums`` of it, counted by
    the tasks that cut the terms."""
    both = materialize(_terms(docs, id_col, tokens(F.col(text_col)), True, True), "term_counts")
    sums = both.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("tf").alias("n"))
    return both.filter(F.col("bucket").isNull()).drop("bucket"), sums


def term_stats(tf: DataFrame) -> DataFrame:
    """Corpus count ``n`` and document frequency ``df`` per term."""
    return tf.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


def top_terms(stats: DataFrame, k: int, by: str = "n") -> DataFrame:
    """the ``k`` rows with the largest ``by`` (ties: term), without a
    global sort of all terms: count threshold from the histogram, then sort
    only the rows at or above it."""
    hist = stats.groupBy(by).agg(F.count(F.lit(1)).alias("c"))
    # the cut lies among the k largest distinct counts (each stands for at
    # least one term): keep those (a bounded top-k) before the running sum
    hist = hist.orderBy(F.desc(by)).limit(k)
    w = Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("cum", F.sum("c").over(w))
    threshold = cum.filter(F.col("cum") >= k).agg(F.max(by)).scalar()
    cand = stats.filter(F.col(by) >= F.coalesce(threshold, F.lit(0)))
    return cand.orderBy(F.desc(by), F.col("term")).limit(k)


def _bucket(term: Column) -> Column:
    """From the CRC-32 of the first word and that of the rest."""
    first = F.substring_index(term, " ", 1)
    rest = F.substring(term, F.length(first) + 2, F.length(term))
    return (F.crc32(first) * 31 + F.crc32(rest)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def bucket_sums(tf: DataFrame) -> DataFrame:
    """``(bucket, n)``: the occurrences of all terms of a hash bucket, ``BUCKETS``
    rows at most. No term of a bucket occurs more often than that."""
    return tf.groupBy(_bucket(F.col("term")).alias("bucket")).agg(F.sum("tf").alias("n"))


def frequent_stats(tf: DataFrame, k: int, sums: DataFrame | None = None) -> DataFrame:
    """The rows of ``term_stats`` that may be among its ``k`` largest by ``n``
    (ties of the last included), as a table. The terms of the heaviest buckets are
    counted; if the k-th of them occurs at least as often as any bucket left out,
    they are all, else the terms of all buckets that heavy are counted."""
    sums = materialize(bucket_sums(tf) if sums is None else sums, "bucket_sums")

    def counted(least: int) -> DataFrame:
        heavy = sums.filter(F.col("n") >= least).select(F.col("bucket").alias("__bucket"))   # BUCKETS rows at most
        some = tf.join(F.broadcast(heavy), _bucket(F.col("term")) == F.col("__bucket"), "left_semi") if least > 1 else tf
        return materialize(term_stats(some), "term_stats")

    def kth(rows: DataFrame, k: int) -> int:
        """The k-th largest ``n``; 1 (every term has that) if there are fewer."""
        last = rows.select("n").orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
        return last.n if last.c == k else 1

    least = kth(sums, HEAVY * k)
    stats = counted(least)
    if least > 1 and (reached := kth(stats, k)) < least:
        stats = counted(reached)
    return stats


def fit_vocab(tf: DataFrame, n_docs: Column, max_features: int = MAX_FEATURES, sums: DataFrame | None = None) -> DataFrame:
    """``(term_id, term, n, df, idf)``. ``tf`` is read more than once (a table,
    best of all); ``sums`` are its ``bucket_sums`` where they are known."""
    # one written table feeds both the count threshold and the candidates
    top = top_terms(frequent_stats(tf, max_features, sums), max_features)
    ids = top.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    idf = F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + F.lit(1.0)
    return ids.select("term_id", "term", "n", "df", idf.alias("idf"))


def look_up(tf: DataFrame, vocab: DataFrame, how: str = "inner") -> DataFrame:
    """``tf`` with the columns of ``vocab`` (``max_features`` rows at most) of its
    term. The join is on a number, the term's hash, which is much faster than on the
    string; the terms themselves are compared by order, which leaves the hash as the
    only key."""
    v = vocab.select(F.xxhash64("term").alias("__hash"), F.col("term").alias("__term"), *[c for c in vocab.columns if c != "term"])
    same = (F.col("term") <= F.col("__term")) & (F.col("term") >= F.col("__term"))
    return tf.join(F.broadcast(v), (F.xxhash64("term") == F.col("__hash")) & same, how).drop("__hash", "__term")


def raw_weights(tf: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """``(row_id, term_id, term, tf, raw)`` for in-vocabulary terms: tf·idf before
    the rows are scaled to length one."""
    tfw = (F.lit(1.0) + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    return (look_up(tf, vocab.select("term", "term_id", "idf")).withColumn("raw", tfw * F.col("idf"))
            .select("row_id", "term_id", "term", "tf", "raw"))


def row_norms(raw: DataFrame) -> DataFrame:
    """``(row_id, norm)``: one sum a row, combined before the shuffle."""
    return raw.groupBy("row_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))


def transform(tf: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """``(row_id, term_id, term, tf, raw, norm, weight)`` for in-vocabulary terms."""
    j = raw_weights(tf, vocab, sublinear)
    j = j.withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("row_id"))))
    return j.withColumn("weight", F.col("raw") / F.col("norm"))


def fit(docs: DataFrame, id_col: str, text_col: str = "text", max_features: int = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """The vocabulary and the term counts ``(row_id, term, tf)`` it comes from."""
    # tokenising is the expensive part and the fit and the transform both
    # need it: the per-document counts are written once in the shared
    # checkpoint folder (this also cuts the lineage for executor loss)
    tf, sums = term_table(docs, id_col, text_col)
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    return fit_vocab(tf, n_docs, max_features, sums), tf


def fit_transform(docs: DataFrame, id_col: str, text_col: str = "text",
                  max_features: int = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    vocab, tf = fit(docs, id_col, text_col, max_features)
    return vocab, transform(tf, vocab)
