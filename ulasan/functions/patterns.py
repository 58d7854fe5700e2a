"""Regex character classes shared by Spark (Java regex) and the DuckDB oracle (RE2).

Plain ``\\s``/``\\w`` are ASCII-only in Java and differ from Python's Unicode
classes, so every pattern in the library is written with the explicit classes
below. They are valid in both Java and RE2 syntax.
"""

# --- fixed values (must equal the cleaning rules being reproduced) ---------
# Python's str.isspace() set: tab..CR, FS..US, space, NEL, NBSP, Ogham space,
# U+2000..U+200A, line/paragraph separators, narrow NBSP, MMSP, ideographic space.
WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NOT_WS = "[^" + WS[1:]
# the same set as literal characters (for character-set trims)
WS_CHARS = ("".join(chr(c) for c in range(0x09, 0x0e)) + "".join(chr(c) for c in range(0x1c, 0x21))
            + "\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
            + "\u2028\u2029\u202f\u205f\u3000")
# Python's \w for str patterns: letters, numbers, underscore.
WORD = r"[\p{L}\p{N}_]"

# Emoji / symbol ranges removed by the cleaner, in rule order.
EMOJI_RANGES = [
    (0x1F600, 0x1F64F),  # emoticons
    (0x1F300, 0x1F5FF),  # symbols & pictographs
    (0x1F680, 0x1F6FF),  # transport & map
    (0x1F1E0, 0x1F1FF),  # flags
    (0x1F780, 0x1F7FF),  # geometric shapes extended
    (0x1F900, 0x1F9FF),  # supplemental symbols
    (0x1FA00, 0x1FA6F),  # chess symbols
    (0x1FA70, 0x1FAFF),  # symbols extended-A
    (0x2300, 0x23FF),    # miscellaneous technical
    (0x25A0, 0x27BF),    # dingbats / geometric shapes
    (0x2934, 0x2935),    # arrows
    (0x2B05, 0x2B07),    # arrows
    (0x2B1B, 0x2B1C),    # squares
    (0x2B50, 0x2B50),    # star
    (0x200D, 0x200D),    # zero-width joiner
    (0xFE0F, 0xFE0F),    # variation selector-16
]

# Character replacements of the cleaner (one-to-one), in rule order.
CHAR_MAP = [
    ("\u201c", '"'), ("\u201d", '"'),   # curly double quotes
    ("\u2018", "'"), ("\u2019", "'"),   # curly single quotes
    ("\u2013", "-"), ("\u2014", "-"),   # en / em dash
    ("\u00a0", " "),                    # no-break space
]
ELLIPSIS = ("\u2026", "...")

# Strings that a pandas CSV read turns into NULL (its default na_values).
NULL_LIKE = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# Entities decoded natively; any other '&' sequence goes to html.unescape.
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                   ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "\u00a9"),
                   ("&middot;", "\u00b7"), ("&amp;", "&")]
# ---------------------------------------------------------------------------


def emoji_class() -> str:
    parts = []
    for lo, hi in EMOJI_RANGES:
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "[" + "".join(parts) + "]+"
