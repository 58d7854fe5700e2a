"""Date/time scalars (H30-H34). Session time zone is UTC."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in order when a source gives no explicit list.
DEFAULT_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd",
]


def parse_utc(c, formats: list[str] | None = None) -> Column:
    """``pd.to_datetime(errors='coerce', utc=True)``: first format that parses
    wins, anything else is NULL (never an error, ANSI mode or not)."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.trim(col.cast("string"))
    outs = []
    for fmt in formats or DEFAULT_FORMATS:
        if fmt == "weekday_tz":   # 'Wed Jan 01 10:00:00 +0000 2025': drop the weekday
            outs.append(F.try_to_timestamp(F.substring(s, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))
        else:
            outs.append(F.try_to_timestamp(s, F.lit(fmt)))
    return F.coalesce(*outs)


def day_string(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def next_day(c) -> Column:
    return F.date_add(c, 1)


def day_sequence(start, end) -> Column:
    """Inclusive day sequence ``[start, end]`` (empty when start > end)."""
    return F.when(start <= end, F.sequence(start, end, F.expr("INTERVAL 1 DAY"))) \
            .otherwise(F.array().cast("array<date>"))


def ts_string(c) -> Column:
    """Stable text form used in reports and oracle comparisons."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_param(s: str) -> Column:
    """A ``yyyy-MM-dd`` job parameter as a DATE literal."""
    return F.to_date(F.lit(s), "yyyy-MM-dd")


def day_range(start: str, end: str) -> Column:
    """Inclusive days between two ``yyyy-MM-dd`` parameters."""
    return day_sequence(day_param(start), day_param(end))
