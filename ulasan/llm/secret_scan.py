"""Secret scans with multipart linking (operator 4), DataFrame operations only.

Base spans, leftmost and non-overlapping for each kind: ``assign`` (a key word,
a separator and a value of 6 or more characters), ``access`` (AKIA...) and
``hex`` (24 or more hex digits). These are always reported.

Weak candidates are parts that mean nothing alone:

- ``ident``: a named identifier (access_key_id, client_id, user, login);
- ``blob``: 32 or more Base64 characters with upper case, lower case and digits;
- ``endpoint``: an address with a scheme.

They are reported only where complementary parts co-occur within a scope of
``SCOPE`` code points: an ``ident`` beside a secret (assign, hex or blob), a
``blob`` beside an identifier (access or ident), an ``endpoint`` beside an
identifier and a secret. Candidates that overlap a base span are dropped.

Positions come from splitting at the pattern: the lengths of the text between
the matches, and of the matches, sum to each match's place in code points.
Linking is an interval join: spans are dealt by text and scope-sized bin, a
candidate meets the parts of its own and the two adjacent bins, and the exact
distance decides. A very long text with many parts is so spread over its bins.
Candidates that overlap a base span are found by the same bins. Within a text, hits
are gone through in pieces of about the root of their number, since every step of a
fold copies what it has gathered: a text with 100,000 hits takes seconds.

Edge cases: NULL text counts as empty. Spans belong to (doc_id, text), so
repeated rows get the same spans and rows that share an id do not mix. A NULL
doc_id is an id like others. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..functions.text import let
from .common import whole_text

#: Code points between two parts that belong together.
SCOPE = 200
#: Kinds in the order in which they are listed at the same start.
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
MASK = "[SECRET]"

# --- fixed values: the patterns. Group 1 is the part whose length counts. ---
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
IDENT = r"""(?i:access_?key_?id|client_?id|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
BLOB = r"([A-Za-z0-9+/]{32,}={0,2})"
ENDPOINT = r"""((?i:https?|ftp|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+)"""
# ------------------------------------------------------------------------------
#: pattern, least length of group 1, cheap test for texts that may match
RULES = {
    "assign": (ASSIGN, 6, r"(?i)(password|passwd|secret|token|api_?key)"),
    "access": (ACCESS, 20, "AKIA"),
    "hex": (HEX, 24, "[0-9a-f]{24}"),
    "ident": (IDENT, 3, r"(?i)(id|user|username|login)[\"']?\x20*[:=]"),
    "blob": (BLOB, 32, "[A-Za-z0-9+/]{32}"),
    "endpoint": (ENDPOINT, 8, "://"),
}
SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, kind: str) -> Column:
    pattern, least, sign = RULES[kind]
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, p, F.lit(1)).alias("value"))
    none = F.array().cast(f"array<{SPAN}>")
    nothing = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        good = F.length(x["value"]) >= least
        if kind == "blob":
            good = good & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]")
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")).cast(SPAN)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")).cast(SPAN))

    def join(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + piece["at"]).alias("at"), F.concat(acc["out"], F.array(moved(piece["out"], acc["at"]))).alias("out"))

    # every piece from zero on, then the pieces moved to their places
    found = let(parts, lambda all_parts: F.aggregate(
        _pieces(all_parts, lambda piece: F.aggregate(piece, nothing, step)),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), join, lambda acc: F.flatten(acc["out"])))
    maybe = text.contains(sign) if sign in ("AKIA", "://") else text.rlike(sign)
    return F.when(maybe, found).otherwise(none)


def _pieces(values: Column, body) -> Column:
    """``body`` of each piece of a non-empty array, in order."""
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values)))).cast("int")
    return let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / n).cast("int")),
                                           lambda i: body(F.slice(values, i * n + 1, n))))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, base, weak)`` of every row: sorted base spans and
    weak candidates, written to the shared checkpoint folder."""
    text = whole_text()
    by_kind = [_spans(text, k) for k in KINDS]
    base = F.sort_array(F.concat(*by_kind[:3]))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_hash"), base.alias("base"),
                        F.concat(*by_kind[3:]).alias("weak"))
    return materialize(found, "secrets")


def _clear(spans: DataFrame, key: list[str], scope: int) -> DataFrame:
    """The spans without the weak ones that overlap a base span: both stand in
    every bin that they cover, and overlapping ones share one."""
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))))
    base = binned.where("kind < 3").select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), F.col("bin").alias("b_bin"),
                                           F.col("start").alias("b0"), F.col("end").alias("b1"))
    over = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")) & (F.col("bin") == F.col("b_bin"))
    hit = (binned.where("kind >= 3").join(base, over & (F.col("b0") < F.col("end")) & (F.col("start") < F.col("b1")), "left_semi")
           .select(*[F.col(c).alias(f"h_{c}") for c in (*key, "kind", "start")]).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("h_doc_id"))
    for c in ("text_hash", "kind", "start"):
        same = same & (F.col(c) == F.col(f"h_{c}"))
    return spans.join(hit, same, "left_anti")


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, text_hash, linked)``: the weak candidates that complementary
    parts confirm, for the texts that have any."""
    key = ["doc_id", "text_hash"]
    some = scanned.where(F.size("weak") > 0).dropDuplicates(key)
    spans = _clear(some.select(*key, F.explode(F.concat("base", "weak")).alias("s")).select(*key, "s.*"), key, scope)
    ident, secret = F.col("kind").isin(1, 3), F.col("kind").isin(0, 2, 4)
    # a part stands in every bin that its text and scope touch, a candidate in its first
    parts = (spans.where(ident | secret)
             .select(*key, F.col("start").alias("b0"), F.col("end").alias("b1"), ident.alias("is_ident"),
                     F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("bin")))
    weak = spans.where("kind >= 3").select(*key, "start", "kind", "end", F.explode(
        F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"))
    same = [weak["doc_id"].eqNullSafe(parts["doc_id"]), weak["text_hash"] == parts["text_hash"], weak["bin"] == parts["bin"]]
    near = (parts["b0"] - weak["end"] <= scope) & (weak["start"] - parts["b1"] <= scope)
    other = (parts["b0"] != weak["start"]) | (parts["b1"] != weak["end"])
    met = weak.join(parts, [*same, near, other]).select(weak["doc_id"], weak["text_hash"], "start", "kind", "end", "is_ident")
    seen = met.groupBy(*key, "start", "kind", "end").agg(F.max("is_ident").alias("i"), F.max(~F.col("is_ident")).alias("s"))
    good = F.when(F.col("kind") == 3, F.col("s")).when(F.col("kind") == 4, F.col("i")).otherwise(F.col("i") & F.col("s"))
    return seen.where(good).groupBy(*key).agg(F.collect_list(F.struct("start", "kind", "end").cast(SPAN)).alias("linked"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row: ``doc_id, text_hash, base, spans`` (sorted arrays of
    start, kind number and end in code points)."""
    found = scan(docs)
    linked = link(found, scope).withColumnsRenamed({"doc_id": "l_id", "text_hash": "l_hash"})
    both = found.join(linked, found["doc_id"].eqNullSafe(linked["l_id"]) & (found["text_hash"] == linked["l_hash"]), "left")
    return both.select("doc_id", "text_hash", "base", F.sort_array(F.concat(
        "base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def mask(text: Column, spans: Column, by: str = MASK) -> Column:
    """The text with every run of overlapping spans (sorted) put as ``by``. Each
    piece of the spans cuts its own stretch of the text, so that no step counts
    code points from the text's beginning."""
    def stretch(acc: Column, piece: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(piece, lambda s: s["end"])))
        return let(F.substring(text, acc["at"] + 1, end - acc["at"]), lambda local: F.aggregate(
            piece, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")),
            lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(
                F.concat(a["out"], F.array(F.substring(local, a["at"] - acc["at"] + 1, s["start"] - a["at"]), F.lit(by)))).alias("out")),
            lambda a: F.struct(a["at"].alias("at"), F.array_join(a["out"], "").alias("out"))))

    def step(acc: Column, piece: Column) -> Column:
        return let(stretch(acc, piece), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(_pieces(spans, lambda piece: piece), start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked; all columns stay. Only
    masked rows have their ``n_chars``, if there is one, counted anew."""
    found = secret_spans(docs, scope).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__hash"])
    on = docs["doc_id"].cast("long").eqNullSafe(found["__id"]) & (F.sha2(docs["text"], 256) == found["__hash"])
    out = docs.join(found, on, "left")
    masked = F.when(F.col("__spans").isNotNull(), mask(docs["text"], F.col("__spans"))).otherwise(docs["text"])
    keep = [masked.alias(c) if c == "text" else F.when(F.col("__spans").isNotNull(), F.length(masked)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars" else docs[c] for c in docs.columns]
    return out.select(*keep)
