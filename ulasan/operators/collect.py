"""Keyword × day collection.

The reference asks a search service, per day and keyword, for the newest N
posts it has not stored yet. Here the posts are a table and each rule is a
relational step: the day grid is a per-keyword ``sequence`` explode (no cross
join), phrase matching is an equi-join of per-post n-grams with the phrase list,
the whole post predicate an interval join by time bins, caps are ``row_number``
windows (planned as ``WindowGroupLimit`` before the shuffle), and the sequential first-come rule is
a bounded per-day greedy pass.
"""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import day_sequence, day_string, next_day
from ..functions.text import let, ngrams, tokens

# --- fixed value: the search string of one (keyword, day) request ----------
QUERY_TEMPLATE = "{keyword} since:{since} until:{until} lang:id -filter:retweets"
# ---------------------------------------------------------------------------

BROADCAST_MAX_KEYWORDS = 100_000
#: Bits of the n-gram filter for each phrase, and its largest size (2 MB). A fuller
#: filter passes more n-grams on to the join, which decides.
FILTER_BITS, FILTER_MAX_BITS = 16, 1 << 24


def keyword_frame(spark: SparkSession, phrases: list[str]) -> DataFrame:
    """``(kw_rank, phrase)`` with 1-based rank in list order."""
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(phrases)], "kw_rank int, phrase string")


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a side whose row count is known and bounded; otherwise leave
    the join strategy to the planner (AQE switches at run time)."""
    return F.broadcast(df) if n_rows <= BROADCAST_MAX_KEYWORDS else df


def search_query(keyword: Column, day: Column) -> Column:
    return F.format_string(
        QUERY_TEMPLATE.replace("{keyword}", "%s").replace("{since}", "%s").replace("{until}", "%s"),
        keyword, day_string(day), day_string(next_day(day)))


def keyword_day_grid(keywords: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every (keyword, day) with day in ``[start, end]``; ``start``/``end``
    may be columns of ``keywords``. Adds the search string (H28)."""
    g = keywords.select("*", F.explode(day_sequence(start, end)).alias("day"))
    return g.withColumn("query", search_query(F.col("keyword"), F.col("day")))


def _phrase_grams(phrases: DataFrame, min_len: int) -> DataFrame:
    """Adds ``gram``, the phrase's lower-cased words joined by a space, and
    ``n_words``; phrases without a word go, since nothing matches them."""
    words = phrases.withColumn("__t", tokens(F.col("phrase"), min_len))
    return (words.withColumn("gram", F.array_join("__t", " ")).withColumn("n_words", F.size("__t"))
            .filter("n_words > 0").drop("__t"))


def _gram_filter(phrases: DataFrame, n_phrases: int) -> tuple[int, Callable[[Column], Column]]:
    """The longest phrase's number of words, and a test that every phrase's gram
    passes and few others do: one bit of a bitmap for each gram's hash. The bitmap
    is sized from the list, made in one aggregate of at most a row for each of its
    words, and folded into the expression as a literal."""
    bits = min(FILTER_MAX_BITS, 1 << max(6, (FILTER_BITS * max(1, n_phrases) - 1).bit_length()))

    def place(gram: Column) -> Column:
        return F.hash(gram).bitwiseAND(F.lit(bits - 1))

    def word(gram: Column) -> Column:
        return F.shiftright(place(gram), 6)

    rows = (phrases.groupBy(word(F.col("gram")).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("gram")))).alias("b"),
                 F.max("n_words").alias("n")).collect())
    table = [0] * (bits // 64)
    for r in rows:
        table[r["w"]] = r["b"]
    bitmap = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def passes(gram: Column) -> Column:
        # a shift of 64 bits goes by the place's last six
        return F.call_function("shiftright", F.get(bitmap, word(gram)), place(gram)).bitwiseAND(F.lit(1)) == 1

    return max((r["n"] for r in rows), default=0), passes


def _found_grams(text: Column, min_len: int, longest: int, passes: Callable[[Column], Column]) -> Column:
    """A post's distinct n-grams that pass the filter."""
    if not longest:
        return F.array().cast("array<string>")
    return let(tokens(text, min_len), lambda t: F.array_distinct(F.filter(
        F.flatten(F.array(*[ngrams(t, n) for n in range(1, longest + 1)])), passes)))


def match_keywords(posts: DataFrame, phrases: list[str], id_col: str, text_col: str = "text",
                   max_len: int | None = None, min_len: int = 1, lang: str | None = None,
                   lang_col: str = "lang") -> DataFrame:
    """``(id, kw_rank, phrase)`` for every post whose lower-cased word
    tokens contain the phrase's tokens contiguously. Each post emits those of its
    distinct n-grams (n ≤ longest phrase) that pass a hash filter of the list, and
    they join the phrases on equality: no nested-loop join, no pairs of
    non-matching rows, one plan whatever the length of the list.

    ``max_len``: longest phrases, in words, that are looked for (None: all).
    ``min_len``: shorter words of phrases and posts are skipped (1: none are).
    ``lang``: only posts of this language (``None``: all, NULL included)."""
    if lang is not None:
        posts = posts.filter(F.col(lang_col) == lang)
    kw = _phrase_grams(keyword_frame(posts.sparkSession, phrases), min_len)
    if max_len is not None:
        kw = kw.filter(F.col("n_words") <= max_len)
    longest, passes = _gram_filter(kw, len(phrases))
    g = posts.select(F.col(id_col), F.explode(_found_grams(F.col(text_col), min_len, longest, passes)).alias("gram"))
    return g.join(small(kw, len(phrases)), "gram").select(id_col, "kw_rank", "phrase")


def search_posts(posts: DataFrame, requests: DataFrame, id_col: str = "post_id", text_col: str = "text",
                 ts_col: str = "ts", lang_col: str = "lang", repost_col: str = "is_repost",
                 min_len: int = 1) -> DataFrame:
    """``(id, kw_rank, phrase, since, until)`` for every post and request
    where the post holds the phrase, ``since <= ts < until``, the language is the
    request's and the post is no repost (unless the request takes them).

    ``requests``: ``(kw_rank, phrase, since, until, lang, reposts)``; ``lang`` NULL
    takes every language, ``reposts`` true takes reposts too (NULL: false). This
    is an interval join: requests stand in every time bin that they touch (bins as
    wide as the mean request), a post in the one of its time, and both meet on
    (gram, bin); exact bounds, language and repost decide among those.

    A post without text or time matches nothing, nor does a request without both
    bounds or with ``since >= until``; a post without language matches requests
    without one only; ``is_repost`` NULL is no repost. A repeated post row or
    request gives its rows again."""
    span = F.col("until").cast("double") - F.col("since").cast("double")
    good = requests.select("kw_rank", "phrase", F.col("since").cast("timestamp").alias("since"),
                           F.col("until").cast("timestamp").alias("until"), F.col("lang").alias("__lang"),
                           F.coalesce("reposts", F.lit(False)).alias("__reposts")).filter("since < until")
    good = _phrase_grams(good, min_len)
    seen = good.agg(F.count(F.lit(1)).alias("n"), F.avg(span).alias("width"), F.sum(span).alias("total")).first()
    width = max(1.0, seen["width"] or 1.0)
    longest, passes = _gram_filter(good, seen["n"])

    def bin_of(t: Column) -> Column:
        return F.floor(t.cast("double") / F.lit(width))

    # the last instant is outside, so a request that ends on an edge does not enter the next bin
    last = F.greatest(bin_of(F.col("since")), F.ceil(F.col("until").cast("double") / F.lit(width)) - 1)
    binned = good.select("*", F.explode(F.sequence(bin_of(F.col("since")), last)).alias("__bin"))
    found = posts.select(F.col(id_col), F.col(ts_col).cast("timestamp").alias("__ts"), F.col(lang_col).alias("__post_lang"),
                         F.coalesce(F.col(repost_col), F.lit(False)).alias("__repost"),
                         F.explode(_found_grams(F.col(text_col), min_len, longest, passes)).alias("gram"))
    found = found.withColumn("__bin", bin_of(F.col("__ts")))
    met = found.join(small(binned, 2 * seen["n"] + int((seen["total"] or 0) / width)), ["gram", "__bin"])
    return met.filter((F.col("__ts") >= F.col("since")) & (F.col("__ts") < F.col("until"))
                      & (F.col("__lang").isNull() | (F.col("__lang") == F.col("__post_lang")))
                      & (F.col("__reposts") | ~F.col("__repost"))).select(id_col, "kw_rank", "phrase", "since", "until")


def first_keyword(matches: DataFrame, id_col: str, phrases: list[str]) -> DataFrame:
    """Each id is attributed to its first matching keyword (min rank);
    a primitive ``min`` keeps the aggregate hash-based and partial, and the
    phrase comes from the small keyword list (no second pass over matches)."""
    best = matches.groupBy(id_col).agg(F.min("kw_rank").alias("kw_rank"))
    kw = keyword_frame(matches.sparkSession, phrases)
    return best.join(small(kw, len(phrases)), "kw_rank").select(id_col, "kw_rank", "phrase")


def cap_newest(posts: DataFrame, group: list[str], n: int, ts: str = "ts", tiebreak: str | None = None,
               name: str = "rk") -> DataFrame:
    """Newest ``n`` rows per group (ties broken by the id, newest
    id first). ``row_number() <= n`` is planned as a partial WindowGroupLimit
    before the shuffle, so a hot group ships at most n rows per map task."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    w = Window.partitionBy(*group).orderBy(*order)
    return posts.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def greedy_collect(candidates: DataFrame, n: int, id_col: str = "post_id", ts: str = "ts",
                   day: str = "day", n_keywords: int | None = None) -> DataFrame:
    """Per day, keywords in rank order each take their newest ``n``
    candidates not taken by an earlier keyword (ids seen before must already
    be anti-joined away).

    ``candidates``: ``(day, kw_rank, id, ts)``. Exact and bounded: an earlier
    keyword removes at most n·(r-1) of keyword r's candidates, so keeping the
    newest n·r per (day, r) loses nothing; each day's greedy pass then sees at
    most n·K(K+1)/2 rows however hot the day is. ``n_keywords``: K, where the
    caller knows it (None: the largest rank is looked up first)."""
    w = Window.partitionBy(day, "kw_rank").orderBy(F.col(ts).desc(), F.col(id_col).desc())
    k = n_keywords or candidates.select(F.max("kw_rank")).first()[0] or 1     # a scalar
    ranked = candidates.withColumn("__r", F.row_number().over(w))
    # literal bound first (planned as a WindowGroupLimit before the shuffle, so
    # a hot (day, keyword) ships ≤ n·K rows per map task), then the exact n·r
    pruned = (ranked.filter(F.col("__r") <= F.lit(int(k) * n))
                    .filter(F.col("__r") <= F.col("kw_rank") * n).drop("__r"))
    schema = pruned.select(day, "kw_rank", id_col, ts).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kw_rank", ts, id_col], ascending=[True, False, False])
        taken, out = set(), []
        for r, grp in pdf.groupby("kw_rank", sort=True):
            k = 0
            for row in grp.itertuples(index=False):
                pid = getattr(row, id_col)
                if pid in taken:
                    continue
                taken.add(pid)
                out.append(row)
                k += 1
                if k >= n:
                    break
        return pd.DataFrame(out, columns=pdf.columns) if out else pdf.iloc[0:0]

    return pruned.select(day, "kw_rank", id_col, ts).groupBy(day).applyInPandas(run, schema)


def collection_rollup(grid: DataFrame, collected: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Saved posts per cell (0 for empty cells), with per-day and grand
    totals and the number of requests, as ``rollup``."""
    # count per cell first (partially aggregated, so a hot cell never reaches
    # one task whole), then attach the small per-cell counts to the grid
    per_cell = collected.groupBy(*keys).agg(F.count(id_col).alias("n"))
    cells = grid.select(*keys).join(per_cell, keys, "left") \
                .select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return cells.rollup(*keys).agg(F.sum("n").cast("long").alias("n_saved"),
                                  F.count(F.lit(1)).alias("n_queries"))
