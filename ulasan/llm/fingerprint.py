"""Document fingerprints by one-permutation MinHash (operator 6), DataFrame
operations only.

- Shingles: five words (blank-separated, lower case); a text of fewer words is
  one shingle.
- One permutation: each shingle is hashed once. The hash's top 8 bits name one
  of ``BINS`` = 256 bins, and a bin keeps its smallest hash. Sorting the hashes
  together with one largest value per bin and keeping the first of each bin
  gives all bins in order, the empty ones recognisable.
- Optimal densification: an empty bin takes the value of a filled bin, chosen by
  the empty bin's own random order of all bins: some hashed attempts, and if
  they all hit empty bins, the filled bin whose hash with this bin is smallest.
  The order is the same for all documents, so equal choices mean equal sets.
- Packed bits: the low ``BITS`` = 4 bits of each value, hashed with its bin (bins
  that share a value must not agree by chance all at once), 16 bins to a long.
  Likeness is the share of equal bins, corrected for values that agree in their
  low bits by chance: ``(share - 1/16) / (15/16)``, at least 0.

The next document (descending id) comes from range buckets: rows are dealt by
quantiles of the id, the first row of each bucket also goes to the end of the
bucket before it, and ``lead`` runs within the buckets. Only bucket bounds and
each bucket's largest id (a few numbers a bucket) reach the driver.

Edge cases: a text without words (or NULL) has the empty fingerprint, like only
to another empty one. Rows that share an id follow one another by text; rows
whose id is NULL come last. A single row is its own next row. Extra columns are
not read.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, whole_text

WORDS = 5
BINS = 256
BITS = 4
#: Hashed attempts before the full order of the filled bins decides.
ATTEMPTS = 8
BLANKS = "\t\n\x0b\x0c\r"
_LOW = (1 << 56) - 1
_FIRST_BITS = 0x1111111111111111


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    blank = F.translate(F.lower(text), BLANKS, " " * len(BLANKS))
    hashes = F.transform(F.filter(F.split(blank, " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        n = F.size(h)
        rows = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n >= words, rows).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, rolled)


def _bin(x: Column) -> Column:
    """0 to 255, in the order of signed longs."""
    return F.shiftright(x, 56) + BINS // 2


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """16 longs; an empty array for a text without words."""
    ends = F.array(*[F.lit(((b - BINS // 2) << 56) | _LOW) for b in range(BINS)])

    def first_of_bins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    def filled(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_LOW)) != _LOW

    def densified(dense: Column) -> Column:
        def attempt(i: Column, t: int) -> Column:
            return let(F.get(dense, F.xxhash64(i, F.lit(t)).bitwiseAND(F.lit(BINS - 1)).cast("int")), lambda x: F.when(filled(x), x))

        def least(i: Column) -> Column:
            return F.array_min(F.transform(F.filter(dense, filled), lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("order"), x.alias("x"))))["x"]

        return F.transform(dense, lambda x, i: F.when(filled(x), x).otherwise(F.coalesce(*[attempt(i, t) for t in range(ATTEMPTS)], least(i))))

    def packed(values: Column) -> Column:
        return let(F.transform(values, lambda x, i: F.xxhash64(x, i)), lambda low: F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), lambda g: F.aggregate(
            F.slice(low, g * 16 + 1, 16), F.lit(0).cast("long"),
            lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))))

    def whole(h: Column) -> Column:
        dense = let(F.sort_array(F.concat(h, ends)), first_of_bins)
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(let(let(dense, densified), packed))

    return let(shingle_hashes(text, words), whole)


def hex_string(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1, of the texts of two fingerprints."""
    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_bit = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(_FIRST_BITS)))

    differing = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda acc, n: acc + n)
    chance = 1 / (1 << BITS)
    share = (1 - differing / F.lit(float(BINS)) - chance) / (1 - chance)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(share, F.lit(0.0))))


def with_next(rows: DataFrame, order_id: str, tie: str, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``next_<column>``: the values of the row that follows in descending
    order of ``order_id`` (then by ``tie``); the first row follows the last."""
    spark = rows.sparkSession
    buckets = buckets or shuffle_partitions(spark)
    low = -(1 << 63)
    ids = rows.select(F.coalesce(F.col(order_id), F.lit(low)).alias("__id"))
    bounds = sorted({int(x) for x in ids.stat.approxQuantile("__id", [k / buckets for k in range(1, buckets)], 0.25 / buckets)}) if buckets > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col("__id")))
    top = ids.select("__id", bucket.alias("__b")).groupBy("__b").agg(F.max("__id").alias("top")).orderBy("__b").collect()
    # the largest id of each bucket also ends the next higher one, the very largest the lowest
    ghost_of = [(r["top"], top[(k + 1) % len(top)]["__b"]) for k, r in enumerate(top)]
    ghosts = F.broadcast(spark.createDataFrame(ghost_of, "__top long, __to int"))       # one row a bucket
    keyed = rows.withColumn("__id", F.coalesce(F.col(order_id), F.lit(low))).withColumn("__b", bucket)
    twice = keyed.join(ghosts, F.col("__id") == F.col("__top"), "left").withColumn("__g", F.explode(F.when(
        F.col("__to").isNull(), F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost")), F.struct(F.col("__to").alias("b"), F.lit(True).alias("ghost"))))))
    w = Window.partitionBy("__g.b").orderBy(F.col("__g.ghost"), F.col("__id").desc(), F.col(tie))
    out = twice.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("__g.ghost")).select(*rows.columns, *[f"next_{c}" for c in columns])


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and its next document, with all
    three fingerprints: ``doc_id, n_chars, edited, fp, edited_fp, next_fp``."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = with_next(text.withColumn("fp", fingerprint(F.col("text"))), "doc_id", "text", ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.col("next_fp"))
    return out.withColumn("edited_fp", fingerprint(F.col("edited")))
