"""SimHash near-duplicates through Golay codes (operator 7).

A document's fingerprint has 64 bits: a bit is set if it is set in over half of
its shingles' hashes. Fingerprints link at ``MAX_BITS`` = 2 or fewer differing
bits, and documents belong to the connected components of the links.

Candidate pairs come from the perfect binary Golay code (23,12), in which every
23-bit word lies within 3 bits of exactly one codeword. A segment's keys are
the indices of the codewords that its word and the word's 23 neighbours decode
to (one key, or six). Two words that differ in at most 2 bits have a common
neighbour in between, hence a common key.

The fingerprint has three segments (22, 21 and 21 bits). Two differing bits
leave at least one segment without an error (pigeonhole), and the next segment
has 2 errors at most. So a pair that links shares, for some i, the key
``(i, segment i as it is, a Golay key of segment i + 1)``: up to 18 keys for a
fingerprint, each of 33 to 34 bits. The keys are joined and each pair's exact
bit distance is verified, so no link is lost and none is wrong.

Equal fingerprints are collapsed to one row before anything is joined, so
thousands of copies cost one row for each map task.

Edge cases: NULL text counts as empty. A text without words has fingerprint
zero and links like any other. A row whose doc_id is NULL gets a fingerprint,
and the component of the rows that have the same one (NULL if no such row has
an id). Repeated rows stay. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: (first bit, bits) of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code (23,12).
GOLAY = 0b110001110101


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()                     # bytes: only A-Z are lowered; ASCII blanks split
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    if len(tokens) < words:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops[words - 1:])]
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        part = np.array(hashes[k:k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, text_hash, fp)``, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.encode("utf-8"), words) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = whole_text()
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def golay_decoder() -> np.ndarray:
    """The error pattern (3 bits at most) of each of the 2048 syndromes."""
    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    unit = [syndrome(1 << i) for i in range(23)]
    table = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        table[unit[i]] = 1 << i
        for j in range(i):
            table[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                table[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return table


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the codeword indices of it and its neighbours, in
    24 columns, a repeated index replaced by -1."""
    errors = golay_decoder()
    unit = np.zeros(23, dtype=np.int64)
    for i in range(23):
        word = 1 << i
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        unit[i] = word
    syndrome = np.zeros(len(words), dtype=np.int64)
    for i in range(23):
        syndrome ^= np.where(words >> i & 1, unit[i], 0)
    near = np.concatenate([[0], 1 << np.arange(23)])
    shift = np.concatenate([[0], unit])
    out = np.sort((words[:, None] ^ near ^ errors[syndrome[:, None] ^ shift]) >> 11, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def candidate_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp, rep)`` for every key of every distinct fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rep = batch.column(1).to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            segment = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            for i in range(3):
                golay = golay_keys(segment[(i + 1) % 3])
                row, col = np.nonzero(golay >= 0)
                key = (np.int64(i) << 40) | (segment[i][row] << 12) | golay[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(rep[row])], names=["key", "fp", "rep"])

    return fps.select("fp", "rep").mapInArrow(run, "key long, fp long, rep long")


def links(reps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)`` of representatives whose fingerprints differ in
    ``max_bits`` (2 at most) or fewer bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys guarantee up to 2 differing bits")
    keys = candidate_keys(reps)
    x, y = keys.alias("x"), keys.alias("y")
    near = (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
    return x.join(y, (F.col("x.key") == F.col("y.key")) & near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fp, component_id`` (the
    smallest doc_id that can be reached over links, itself included)."""
    fps = materialize(fingerprints(docs, words), "simhash")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "simhash")
    roots = components(links(reps, max_bits))
    where = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(where, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each_group(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component; of
    rows that share that id, the one with the smallest text hash."""
    groups = materialize(simhash_groups(docs, words, max_bits), "simhash")
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    stay = groups.groupBy("component_id", alone.alias("alone")).agg(first.alias("s")).select(
        F.col("s.doc_id").alias("__id"), F.col("s.text_hash").alias("__hash"))
    keyed = docs.withColumns({"__doc": docs["doc_id"].cast("long"), "__text": F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
    kept = keyed.join(stay, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    w = Window.partitionBy("__doc", "__text").orderBy(F.lit(1))
    return kept.withColumn("__row", F.row_number().over(w)).where("__row = 1").select(*docs.columns)
