"""Config-driven multi-source scan.

Each ``SourceSpec`` names a path, a format, the column (or expression) that
holds the text, the one that holds the date and the columns that give the
source's natural row order; a source without such columns is ordered by its
files: path, place of the split in the file, row. ``scan_sources`` maps every
source to the canonical ``(text, date, source, source_rank, row_key)`` shape and
unions them in config order; missing paths are skipped.

``row_key`` is an array with one struct per order column, so sources with
different keys fit one table: integers, dates and times in ``num``, fractions in
``real``, all else as ``str``, each compared by its own type (NULL first).
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_utc
from ..functions.patterns import NULL_LIKE

KEY = "struct<num:bigint,real:double,str:string>"
CANONICAL = f"text string, date timestamp, source string, source_rank int, row_key array<{KEY}>"


@dataclass
class SourceSpec:
    label: str
    path: str
    text: str | Column
    date: str | Column | None = None
    order: list[str] = field(default_factory=list)
    fmt: str = "parquet"
    date_formats: list[str] | None = None
    options: dict = field(default_factory=dict)
    schema: str | None = None


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: str | None = None, **options) -> DataFrame | None:
    """Read a table; ``None`` when the path does not exist."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        opts = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}
        opts.update(options)
        options = opts
    r = r.options(**options)
    if schema:
        r = r.schema(schema)
    try:
        return r.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def null_like_to_null(c: Column) -> Column:
    """pandas read_csv default NA strings become NULL."""
    return F.when(c.isin(NULL_LIKE), F.lit(None).cast("string")).otherwise(c)


def _key(value: Column, kind: T.DataType) -> Column:
    num, real, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        num = F.unix_micros(value.cast("timestamp"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        num = value.cast("bigint")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        real = value.cast("double")
    else:
        text = value.cast("string")
    return F.struct(num.alias("num"), real.alias("real"), text.alias("str"))


def _in_order(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` and the keys of its natural row order."""
    if order:
        return df, [_key(F.col(c), df.schema[c].dataType) for c in order]
    place = {"__path": "_metadata.file_path", "__start": "_metadata.file_block_start"}
    # the id grows along each split; splits are told apart by path and start
    df = df.withColumns({n: F.col(c) for n, c in place.items()}).withColumn("__row", F.monotonically_increasing_id())
    return df, [_key(F.col(c), df.schema[c].dataType) for c in (*place, "__row")]


def canonical(df: DataFrame, spec: SourceSpec, rank: int, na_like: bool = True) -> DataFrame:
    text = _col(spec.text).cast("string")
    if na_like:
        text = null_like_to_null(text)
    date = (parse_utc(_col(spec.date), spec.date_formats) if spec.date is not None
            else F.lit(None).cast("timestamp"))
    df, keys = _in_order(df, spec.order)
    return df.select(text.alias("text"), date.alias("date"), F.lit(spec.label).alias("source"),
                     F.lit(rank).alias("source_rank"), F.array(*keys).alias("row_key"))


def scan_sources(spark: SparkSession, specs: list[SourceSpec], na_like: bool = True) -> DataFrame:
    parts = []
    for rank, spec in enumerate(specs):
        df = read_table(spark, spec.path, spec.fmt, spec.schema, **spec.options)
        if df is None:        # missing source: skip, keep going
            continue
        parts.append(canonical(df, spec, rank, na_like))
    if not parts:
        return spark.createDataFrame([], CANONICAL)
    return reduce(DataFrame.unionByName, parts)


def count_or_zero(spark: SparkSession, path: str, fmt: str = "csv", **options) -> int:
    """Row count of a file, 0 when it is missing."""
    df = read_table(spark, path, fmt, **options)
    return 0 if df is None else df.count()
