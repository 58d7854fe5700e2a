"""DuckDB SQL fragments built from the same fixed values as the Spark side."""
from __future__ import annotations

from ..functions.patterns import (CHAR_MAP, COMMON_ENTITIES, ELLIPSIS, NOT_WS,
                                  NULL_LIKE, WORD, WS, emoji_class)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def strip_ch(x: str, ch: str) -> str:
    c = ch.replace("'", "''")
    return f"regexp_replace({x}, '\\A[{c}]+|[{c}]+\\z', '', 'g')"


def unescape_common(x: str) -> str:
    t = x
    for ent, ch in COMMON_ENTITIES:
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    return t


def clean(x: str) -> str:
    t = unescape_common(f"coalesce({x}, '')")
    t = f"regexp_replace({t}, 'https?://{NOT_WS}+|www\\.{NOT_WS}+', '', 'g')"
    t = f"regexp_replace({t}, '@{WORD}+', '', 'g')"
    t = f"replace({t}, '#', '')"
    src = "".join(a for a, _ in CHAR_MAP)
    dst = "".join(b for _, b in CHAR_MAP)
    t = f"translate({t}, {lit(src)}, {lit(dst)})"
    t = f"replace({t}, {lit(ELLIPSIS[0])}, {lit(ELLIPSIS[1])})"
    t = f"regexp_replace({t}, '{emoji_class()}', '', 'g')"
    t = strip_ws(strip_ch(strip_ch(t, '"'), "'"))
    t = f"regexp_replace({t}, '{WS}*\\.{{2,}}{WS}*', ' ', 'g')"
    t = f"regexp_replace({t}, '{WS}+-{WS}+', ' ', 'g')"
    t = f"translate({t}, chr(10) || chr(13), '  ')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    return strip_ws(strip_ch(strip_ch(strip_ws(t), '"'), "'"))


def word_count(x: str) -> str:
    s = strip_ws(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '{WS}+')) END)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}{{2,}}')"


def null_like(x: str) -> str:
    return f"(CASE WHEN {x} IN ({', '.join(lit(v) for v in NULL_LIKE)}) THEN NULL ELSE {x} END)"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def values(rows: list[tuple], cols: list[str]) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return lit(x)
        return str(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"
