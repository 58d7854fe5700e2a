"""Places of rows within their key, for keys of any size.

A window per key would put a key that holds a third of all rows into one task.
Here the rows are range-partitioned by key and order, so such a key is spread
over many sorted partitions. Each task numbers the rows of every key it holds as
they stream by, and the table is written to the shared checkpoint folder, which
fixes the partitions whatever executor is lost. A key that began in an earlier
partition is its partition's first one, so one offset per partition, summed over
the partitions before, completes the numbers. Rows equal in key and order are
spread by a seeded random number; which of them stands first makes no
difference.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import shuffle_partitions


def rank_in_key(df: DataFrame, key: str, order: list[str], pos: str = "pos") -> DataFrame:
    """``df`` with ``pos`` (long): the row's place, from 0, among the rows of its
    key by ``order`` (NULLs first). ``key`` holds no NULLs; ``part`` and ``salt``
    are no columns of ``df``."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            new = np.ones(n, dtype=bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            if last is not None and keys[0].as_py() == last:
                new[0] = False
            starts = np.where(new, np.arange(n), 0)
            begin = np.maximum.accumulate(starts)
            place = np.arange(n) - begin
            place[: n if not new.any() else int(np.argmax(new))] += seen
            last, seen = keys[n - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(n, part, dtype=np.int32))],
                                             names=[*batch.schema.names, pos, "part"])

    schema = T.StructType([*df.schema.fields, T.StructField(pos, T.LongType()), T.StructField("part", T.IntegerType())])
    by = [key, *order, "salt"]
    dealt = df.withColumn("salt", F.rand(7)).repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    tagged = materialize(dealt.drop("salt").mapInArrow(number, schema), "ranks")
    ends = tagged.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(F.col(key).alias("key"), F.col(pos).alias("p"))).alias("last"))
    counts = ends.select(F.col("last.key").alias("key"), "part", F.lit(1).alias("kind"), (F.col("last.p") + 1).alias("n"))
    asked = ends.select(F.col("first").alias("key"), "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    before = Window.partitionBy("key").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (counts.unionByName(asked).withColumn("offset", F.sum("n").over(before))
               .where("kind = 0 AND offset > 0").select("part", F.col("key").alias("first"), "offset"))
    # one row per partition at most, so its size is that of the partition count
    out = tagged.join(F.broadcast(offsets), "part", "left")
    own = F.coalesce(F.when(F.col(key) == F.col("first"), F.col("offset")), F.lit(0))
    return out.select(*df.columns, (F.col(pos) + own).alias(pos))
