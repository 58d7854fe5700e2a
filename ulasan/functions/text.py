"""Native Column expressions for text: Unicode-exact strip/split, the cleaning
chain, tokenisation and uni+bigram term lists.

Everything here stays inside the JVM (regexp_replace / translate / array
higher-order functions); the only Python is the ``html.unescape`` fallback for
rows whose entities are outside the common set.
"""
from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import (CHAR_MAP, COMMON_ENTITIES, ELLIPSIS, NOT_WS, WORD, WS, WS_CHARS,
                       emoji_class)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (a character-set trim, no regex pass over the text)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def strip_chars(c, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a set of literal characters."""
    return F.btrim(_c(c), F.lit(chars))


def word_count(c) -> Column:
    """``len(s.split())``: number of whitespace-separated words (0 for blank)."""
    s = strip_ws(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, WS + "+")))


def char_length(c) -> Column:
    """Length in code points, like Python ``len``."""
    return F.length(_c(c))


# --- HTML entity decoding -----------------------------------------------------
_ENTITY_ALT = "|".join(e for e, _ in COMMON_ENTITIES)


def needs_full_unescape(c) -> Column:
    """True when, after removing the common entities, an '&' is still followed
    by a character that can start an entity (html.unescape never decodes '&'
    before whitespace, '<', '&', ';' or the end of the text)."""
    return F.regexp_replace(_c(c), _ENTITY_ALT, "").rlike(r"&[^\t\n\f <&;]")


def unescape_common(c) -> Column:
    """Single-pass decode of the common entities (``&amp;`` last, so
    ``&amp;lt;`` becomes ``&lt;`` exactly as one html.unescape pass does)."""
    out = _c(c)
    for ent, ch in COMMON_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


@F.pandas_udf(T.StringType())
def _html_unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)


def html_unescape(c) -> Column:
    """Decode HTML entities exactly like Python ``html.unescape``.

    Texts whose entities are all common ones are decoded natively; only the
    others are sent to an Arrow-batched pandas UDF (all other rows cross as
    NULL, so Python sees just the texts that need it)."""
    src = _c(c)
    slow = _html_unescape_udf(F.when(needs_full_unescape(src), src))
    return F.coalesce(slow, unescape_common(src))


# --- the cleaning chain ---------------------------------------------------------
def _when_contains(t: Column, needles: list[str], step) -> Column:
    """Run ``step`` only on texts holding one of ``needles`` (a substring
    test is far cheaper than a regex scan); the text is bound once."""
    def body(x):
        cond = x.contains(needles[0])
        for nd in needles[1:]:
            cond = cond | x.contains(nd)
        return F.when(cond, step(x)).otherwise(x)
    return let(t, body)


_WS_NOT_SPACE = WS_CHARS.replace(" ", "")


def clean_after_unescape(c) -> Column:
    """Steps after entity decoding, in rule order: URLs, mentions, '#', quote/
    dash map, ellipsis, emoji runs, outer quotes, dot runs, spaced dashes,
    CR/LF, whitespace collapse, final strip.

    Every step treats all Unicode whitespace alike (as ``\\s`` or ``strip()``)
    and the collapse turns each run into one U+0020, so all whitespace is
    mapped to U+0020 up front; later patterns then need only a plain space.
    Steps whose pattern needs a literal ('http'/'www.', '@', '..', '-') or a
    character at or above U+200D (emoji) are skipped on texts without it."""
    t = F.translate(_c(c), _WS_NOT_SPACE, " " * len(_WS_NOT_SPACE))
    t = _when_contains(t, ["http", "www."], lambda x: F.regexp_replace(x, r"https?://[^ ]+|www\.[^ ]+", ""))
    t = _when_contains(t, ["@"], lambda x: F.regexp_replace(x, rf"@{WORD}+", ""))
    t = F.replace(t, F.lit("#"), F.lit(""))
    src = "".join(a for a, _ in CHAR_MAP)
    dst = "".join(b for _, b in CHAR_MAP)
    t = F.translate(t, src, dst)
    t = F.replace(t, F.lit(ELLIPSIS[0]), F.lit(ELLIPSIS[1]))
    t = let(t, lambda x: F.when(x.rlike(r"[\x{200d}-\x{10ffff}]"), F.regexp_replace(x, emoji_class(), ""))
            .otherwise(x))
    t = F.btrim(strip_chars(strip_chars(t, '"'), "'"), F.lit(" "))
    t = _when_contains(t, [".."], lambda x: F.regexp_replace(x, r" *\.{2,} *", " "))
    t = _when_contains(t, ["-"], lambda x: F.regexp_replace(x, r" +- +", " "))
    t = _when_contains(t, ["  "], lambda x: F.regexp_replace(x, r" {2,}", " "))
    t = F.btrim(strip_chars(strip_chars(F.btrim(t, F.lit(" ")), '"'), "'"), F.lit(" "))
    return t


def clean_text(c) -> Column:
    """The full cleaning chain as one Column (null → '')."""
    return clean_after_unescape(html_unescape(F.coalesce(_c(c).cast("string"), F.lit(""))))


def clean_text_df(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, clean_text(col))


def cleaned_keep(x: Column, min_words: int = 2, min_chars: int = 5) -> Column:
    """Blank/short filter for texts that came out of ``clean_after_unescape``.
    Such texts have no outer whitespace and only single U+0020 between words,
    so 'strip() != ""' is 'x != ""' and the word count is the number of
    spaces + 1; exact, and no further regex pass over the text."""
    words = F.size(F.split(x, " ", -1))
    return (x != "") & (words >= min_words) & (F.length(x) >= min_chars)


def clean_and_filter(df: DataFrame, col: str = "text", min_words: int = 2,
                     min_chars: int = 5) -> DataFrame:
    """Clean ``col`` and keep only rows passing the blank/short filter.

    The cleaned value is bound once inside a lambda and emitted through
    ``explode`` of a 0/1-element array: a generator output is an attribute, so
    the optimizer cannot inline the 15-step chain into the filter, the dedupe
    keys and the projections that follow (it would evaluate it once per use)."""
    kept = F.filter(F.array(clean_text(col)), lambda x: cleaned_keep(x, min_words, min_chars))
    others = [F.col(c) for c in df.columns if c != col]
    return df.select(*others, F.explode(kept).alias(col)).select(*df.columns)


# --- tokens and terms -----------------------------------------------------------
def tokens(c, min_len: int = 2) -> Column:
    """Lower-cased word tokens of at least ``min_len`` word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(f"{WORD}{{{min_len},}}"), 0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    A column expression referenced inside a higher-order-function lambda is
    re-evaluated on every lambda call (tokenising a 20,000-word text once per
    token); binding it to a lambda variable first makes it a plain read."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams(tk: Column) -> Column:
    """Adjacent token pairs joined by a space (empty for < 2 tokens)."""
    return let(tk, lambda t: F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(t) - 1),
                    lambda i: F.concat(t[i - 1], F.lit(" "), t[i]))))


def ngrams(tk: Column, n: int) -> Column:
    """Contiguous n-token sequences joined by a space."""
    if n == 1:
        return tk
    if n == 2:
        return bigrams(tk)
    return let(tk, lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(t) - n),
                    lambda i: F.array_join(F.slice(t, i + 1, n), " "))))


def uni_bigrams(c) -> Column:
    return let(tokens(c), lambda t: F.concat(t, bigrams(t)))


def term_counts(terms: Column) -> Column:
    """Per-row term frequencies as ``array<struct<term,tf>>`` without a shuffle:
    sort the term array, then measure the runs of equal neighbours."""
    def runs(s):
        n = F.size(s)
        # 1-based positions where a run of equal terms ends
        ends = F.filter(F.sequence(F.lit(1), n),
                        lambda i: (i == n) | (F.element_at(s, i) != F.element_at(s, F.least(i + 1, n))))
        return let(ends, lambda e_: F.transform(e_, lambda e, k: F.struct(
            F.element_at(s, e).alias("term"),
            (e - F.when(k == 0, F.lit(0)).otherwise(F.element_at(e_, k))).cast("int").alias("tf"))))
    return let(F.array_sort(terms), lambda s: F.when(F.size(s) == 0,
                                                     F.array().cast("array<struct<term:string,tf:int>>"))
               .otherwise(runs(s)))
