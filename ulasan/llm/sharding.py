"""Sharding by extendible hashing (operator 10), DataFrame operations only.

A row's key is a 60-bit hash of its id. A shard is a hash prefix: starting from
one bucket of depth 0, only buckets above the byte limit are split on another
bit, until each fits. So a row's shard is its shortest prefix whose rows sum to
``max_bytes`` at most, and the directory of a fixed depth maps every prefix to
its shard.

The sizes are summed once at directory depth (a few bits more than the total
needs), summed up to all shorter prefixes from there, and each directory cell
takes its shortest prefix that fits. Cells that are too large even at directory
depth are refined with more bits, and only their rows are read again. Rows with
equal ids have equal hashes, which no number of bits splits; behind the 60 bits
of the id come 60 bits of a hash of the row's number, so even an id that holds
a third of all rows is split. A row that is larger than the limit by itself is
a shard of its own.

The text is read once for its length; all later steps work on four numbers a
row, written to the shared checkpoint folder (row numbers are not the same in a
second run of a lost task, so they are kept, not recomputed). The driver sees
totals and the number of open cells, no rows.

Edge cases: NULL text has 0 bytes; NULL ids share one hash; repeated rows are
rows of their own; an empty table has no shards; other columns are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BITS = 60
MAX_BYTES = 32 << 20


def id_hash(column: str) -> Column:
    """60 bits of the id's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column) -> list[Column]:
    """The first ``depth`` of the 120 bits, as (id part, row part)."""
    cut = lambda name, bits: F.call_function("shiftright", F.col(name), F.lit(BITS) - bits)
    first, second = F.least(depth, F.lit(BITS)), F.greatest(depth - BITS, F.lit(0))
    return [cut("h", first).alias("p"), F.when(second > 0, cut("t", second)).otherwise(F.lit(0).cast("long")).alias("q")]


def _parent(depth: Column, by: Column) -> list[Column]:
    """Prefixes ``by`` bits shorter than the cell's ``p, q`` at ``depth``."""
    from_q = F.least(by, F.greatest(depth - BITS, F.lit(0)))
    return [F.call_function("shiftright", F.col("p"), (by - from_q).cast("int")).alias("pp"),
            F.call_function("shiftright", F.col("q"), from_q.cast("int")).alias("pq")]


def shard(docs: DataFrame, id_column: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``shard`` (the hash
    prefix in binary digits; empty if all rows fit one shard), ``depth``,
    ``shard_bytes`` and ``shard_rows``."""
    rows = materialize(docs.select(
        F.col(id_column), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), id_hash(id_column).alias("h"),
        F.call_function("shiftrightunsigned", F.xxhash64(F.monotonically_increasing_id()), F.lit(64 - BITS)).alias("t"),
        *([F.struct("*").alias("row")] if carry else [])), "shards")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = min(2 * BITS, max(1, math.ceil(math.log2(max(1, total) / max_bytes + 1)) + 4))
    done, open_rows, shallow = [], rows, 0
    while True:
        last = depth == 2 * BITS
        d = F.lit(depth)
        cells = open_rows.groupBy(*_prefix(d)).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        up = cells.select("p", "q", "bytes", "n", F.explode(F.sequence(F.lit(shallow), d)).alias("depth"))
        up = up.select("*", *_parent(d, d - F.col("depth")))
        nodes = up.groupBy("depth", "pp", "pq").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_rows") == 1)
        if last:
            fits = fits | (F.col("depth") == depth)
        best = up.select("p", "q", "depth", "pp", "pq").join(nodes.where(fits), ["depth", "pp", "pq"])
        directory = materialize(best.groupBy("p", "q").agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("s")).select("p", "q", "s.*"), "shards")
        keyed = open_rows.select("*", *_prefix(d))
        done.append(keyed.join(directory, ["p", "q"]))
        if last or not cells.join(directory, ["p", "q"], "left_anti").limit(1).count():
            break
        open_rows = keyed.join(directory, ["p", "q"], "left_anti").drop("p", "q")
        shallow, depth = depth, min(2 * BITS, depth + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    digits = F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lpad(F.bin("t"), BITS, "0"))
    return out.select(F.col(id_column), "n_bytes", digits.substr(F.lit(1), F.col("depth")).alias("shard"),
                      F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> None:
    """Write the rows as Parquet, one folder ``shard=s<prefix>`` each. Every row
    is written once, in the shard it was given: rows carry their columns through
    the sharding, so NULL and repeated ids need no join. The rows of a shard meet
    in one task; its size is bounded."""
    rows = shard(docs.drop("shard"), id_column, text, max_bytes, carry=True).select(F.concat(F.lit("s"), "shard").alias("shard"), "row.*")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
