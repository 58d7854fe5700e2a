"""Suffix-array dedup (operator 3): remove bytes that a ``LENGTH``-byte string
covers which also starts in a document with a smaller doc_id.

A single suffix array of the corpus does not fit a task, so equal strings are
first brought together:

1. Documents are dealt to blocks of bounded size by hash. In each text, every
   50-byte window has a minimizer, the smallest hash of its 16-byte grams. It
   depends on the window's bytes alone, so equal windows have equal minimizers.
   Neighbouring windows with one minimizer form a segment (some 67 bytes).
2. Blocks send their distinct minimizers, and learn which of them occur in two
   documents or more. All other windows are unique. They also learn which
   minimizers are hot: more than ``HOT_SEGMENTS`` segments in all blocks
   together, as at the ends of a passage that many documents share, where each
   document's segment holds its own context.
3. Blocks send the distinct segments with such a minimizer, each once with its
   smallest doc_id. They meet by minimizer. There the segments are concatenated,
   suffixes are sorted in two stages (``suffix``), and runs of suffixes with
   adjacent common prefixes of 50 bytes or more are the equal windows; their
   smallest doc_id goes back to the blocks. Where a minimizer has only one
   distinct segment, all its windows are equal already. Segments of a hot
   minimizer are sent as single windows under the hash of the window instead,
   dealt over all buckets: equal windows still meet, and nothing is dropped.
4. Each document drops the windows whose smallest doc_id is below its own.

Every exchange carries at most one entry for a block and string, so a passage
that a third of all documents share costs one entry a block, and its ends one a
document and window. The numbers of blocks and buckets follow the bytes of the
table alone. An exchange has a row for a block and bucket that share an entry, so
never more rows than entries (a minimizer for some 40 bytes of text), and far fewer
while a bucket holds many entries of a block. Nothing is collected on the driver but
the total size.

Edge cases: NULL text counts as empty. Rows with the same doc_id do not remove
each other's bytes (neither is smaller), nor does a row its own. Rows without a
doc_id are neither compared nor changed. Texts shorter than ``LENGTH`` stay.
Windows are judged on the input. Extra columns are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .suffix import common_prefixes, suffix_array, words_at

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 16 << 20
#: Bytes of text whose minimizers are computed at once.
CHUNK_BYTES = 2 << 20
ID_BITS = 48
#: Ranges of minimizers for each block, so that a range's segments stay few.
BUCKETS_PER_BLOCK = 4
#: Segments of a minimizer, by the blocks' counts, above which they are sent as single windows.
HOT_SEGMENTS = 8192


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(id, document, start, windows)`` of the segments of some texts that
    stand one after another: ``windows`` window starts from ``start`` on."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    words = words_at(np.concatenate([raw, np.zeros(8, dtype=np.uint8)]))
    grams = len(raw) - GRAM + 1
    h = words[:grams] * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = _mix(h + words[8:8 + grams])
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:                                   # minimum of ``span`` grams, doubled
        h = np.minimum(h[:len(h) - span], h[span:])
        span *= 2
    least = np.minimum(h[:n], h[width - span:width - span + n])
    size = np.diff(offsets)
    inside = np.zeros(len(raw) + 1, dtype=np.int32)
    full = size >= LENGTH
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:n]) > 0                         # windows that stay in their text
    edge = np.ones(n, dtype=bool)
    edge[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    edge[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(edge)
    windows = np.diff(np.concatenate([start, [n]]))
    good = inside[start]
    start, windows = start[good], windows[good]
    ids = _mix(least[start]) >> np.uint64(64 - ID_BITS)
    return ids, np.searchsorted(offsets, start, side="right") - 1, start, windows


class Block:
    """The texts of one block, in the order of doc_id and text, and their
    segments chunk by chunk."""

    def __init__(self, docs: pa.Table):
        rows = [(i, (t or "").encode("utf-8")) for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.doc_ids = [r[0] for r in rows]
        self.texts = [r[1] for r in rows]

    def chunks(self):
        """``(first document, bytes, offsets, segments)``; rows without an id,
        which come last, have none."""
        n = sum(i is not None for i in self.doc_ids)
        a = 0
        while a < n:
            b, held = a, 0
            while b < n and (b == a or held + len(self.texts[b]) <= CHUNK_BYTES):
                held += len(self.texts[b])
                b += 1
            joined = b"".join(self.texts[a:b])
            offsets = np.cumsum([0] + [len(t) for t in self.texts[a:b]])
            yield a, joined, offsets, segments(np.frombuffer(joined, dtype=np.uint8), offsets)
            a = b

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct ids, sorted, whether two documents have them, and how many
        segments (told apart by their ends), as a power of two rounded up."""
        ids, owners, ends = [], [], []
        for a, joined, _, (seg, doc, start, windows) in self.chunks():
            ids.append(seg)
            raw, eight = np.frombuffer(joined, dtype=np.uint8), np.arange(8)
            last = start + windows + (LENGTH - 9)
            both = [raw[at[:, None] + eight].view("<u8").ravel().astype(np.uint64) for at in (start, last)]
            ends.append(_mix(_mix(both[0]) + both[1] + windows.astype(np.uint64)))
            owners.append(np.array(self.doc_ids[a:a + int(doc.max()) + 1] if len(doc) else [], dtype=np.int64)[doc])
        if not ids:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint64)
        ids, owners, ends = np.concatenate(ids), np.concatenate(owners), np.concatenate(ends)
        order = np.lexsort((ends, ids))
        ids, owners, ends = ids[order], owners[order], ends[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, dtype=np.int64)
        if not len(first):
            return ids, np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint64)
        new = np.ones(len(ids), dtype=np.int64)
        new[1:] = (ids[1:] != ids[:-1]) | (ends[1:] != ends[:-1])
        power = np.ceil(np.log2(np.add.reduceat(new, first))).astype(np.uint64)
        return ids[first], np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first), power

    def shared(self, wanted: np.ndarray, hot: np.ndarray):
        """The distinct segments whose id is wanted (sorted), in the order of
        their ids: texts, ids, smallest doc_ids; and every occurrence as arrays of
        documents, starts in the text and segment numbers. Segments whose id is
        ``hot`` are given as their windows, under the windows' own ids."""
        number: dict[bytes, int] = {}
        ids, least = [], []
        none = np.zeros(0, dtype=np.int64)
        occ = [(none, none, none)]
        for a, joined, offsets, (seg, doc, start, windows) in self.chunks():
            place = np.minimum(np.searchsorted(wanted, seg), max(0, len(wanted) - 1))
            hit = np.flatnonzero(wanted[place] == seg) if len(wanted) else none
            split = hot[place[hit]] if len(hit) else np.zeros(0, dtype=bool)
            each = np.where(split, windows[hit], 1)
            at = np.repeat(np.arange(len(hit)), each)
            s = start[hit][at] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            end = s + np.where(split, 1, windows[hit])[at] + LENGTH - 1
            d, own = doc[hit][at], []
            for k, x, y, alone, o in zip(seg[hit][at].tolist(), s.tolist(), end.tolist(), split[at].tolist(), d.tolist()):
                text = joined[x:y]
                m = number.get(text)
                if m is None:
                    m = number[text] = len(ids)
                    ids.append(_window_id(text) if alone else k)
                    least.append(self.doc_ids[a + o])          # documents come in the order of their ids
                own.append(m)
            occ.append((a + d, s - offsets[d], np.array(own, dtype=np.int64)))
        ids = np.array(ids, dtype=np.uint64)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        texts = list(number)
        return ([texts[i] for i in order], ids[order], np.array(least, dtype=np.int64)[order],
                tuple(np.concatenate(c) for c in zip(*occ)), rank)


def _window_id(window: bytes) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(window) >> (64 - ID_BITS)


def _pack_ids(ids: np.ndarray, flag: np.ndarray, power: np.ndarray | None = None) -> bytes:
    """48 bits, a flag and a number below 128 each, in seven bytes."""
    value = (ids << np.uint64(1)) | flag.astype(np.uint64)
    if power is not None:
        value |= power << np.uint64(ID_BITS + 1)
    return np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seven = np.frombuffer(data, dtype=np.uint8).reshape(-1, 7)
    value = np.zeros((len(seven), 8), dtype=np.uint8)
    value[:, :7] = seven
    value = value.view("<u8").ravel()
    ids = (value >> np.uint64(1)) & np.uint64((1 << ID_BITS) - 1)
    return ids, (value & np.uint64(1)).astype(bool), value >> np.uint64(ID_BITS + 1)


def _cuts(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted ids."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << ID_BITS) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(ids, edges), [len(ids)]])


def window_minima(texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For segments with common windows: the smallest doc_id of each window,
    by suffix array and adjacent common prefixes."""
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    order = suffix_array(joined, LENGTH)
    left = (begin + size)[owner[order]] - order
    order = order[left >= LENGTH]                              # windows that stay in their segment
    alike = common_prefixes(joined, order, LENGTH) >= LENGTH
    run = np.cumsum(~alike) - 1
    first = np.flatnonzero(~alike)
    minima = np.minimum.reduceat(least[owner[order]], first)[run]
    at = np.full(len(joined), -1, dtype=np.int64)
    at[order] = minima
    return [at[b:b + s - LENGTH + 1] for b, s in zip(begin, size)]


def _minimizer_rows(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        ids, twice, power = Block(docs).minimizers()
        block = docs.column("block")[0].as_py()
        cut = _cuts(ids, buckets)
        rows = [(b, _pack_ids(ids[x:y], twice[x:y], power[x:y])) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                         "ids": pa.array([r[1] for r in rows], pa.binary())})
    return run


def _shared_rows(rows: pa.Table, hot_segments: int) -> pa.Table:
    """The ids of a bucket that two documents have, to each block its own, and
    whether they are hot."""
    parts = [_unpack_ids(x) for x in rows.column("ids").to_pylist()]
    ids, twice, power = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    again = np.zeros(len(s), dtype=bool)
    again[1:] = s[1:] == s[:-1]
    again[:-1] |= s[1:] == s[:-1]
    good = np.empty(len(s), dtype=bool)
    good[order] = again
    good |= np.isin(ids, ids[twice])
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.add.reduceat(np.exp2(power[order].astype(np.float64)), first)
    hot = np.empty(len(s), dtype=bool)
    hot[order] = np.repeat(total > hot_segments, np.diff(np.concatenate([first, [len(s)]])))
    cut = np.cumsum([len(p[0]) for p in parts])[:-1]
    out = [_pack_ids(i[g], x[g]) for i, g, x in zip(np.split(ids, cut), np.split(good, cut), np.split(hot, cut))]
    return pa.table({"block": rows.column("block").cast(pa.int32()), "kind": pa.array([0] * len(out), pa.int32()),
                     "bucket": rows.column("bucket").cast(pa.int32()), "data": pa.array(out, pa.binary())})


def _wanted(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids, sorted, and whether they are hot."""
    got = [d for d, k in zip(answers.column("data").to_pylist(), answers.column("kind").to_pylist()) if k == 0]
    ids, hot, _ = _unpack_ids(b"".join(got))
    order = np.argsort(ids, kind="stable")
    return ids[order], hot[order]


def _segment_rows(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and answers.num_rows:
            texts, ids, least, _, _ = Block(docs).shared(*_wanted(answers))
            cut = _cuts(ids, buckets)
            for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
                if y > x:
                    sizes = np.array([len(t) for t in texts[x:y]], dtype="<u4")
                    body = pa.compress(b"".join(texts[x:y]), codec="zstd", asbytes=True)
                    rows.append((b, _pack_ids(ids[x:y], np.zeros(y - x, dtype=bool)), least[x:y].astype("<i8").tobytes(), sizes.tobytes(), body))
        block = docs.column("block")[0].as_py() if docs.num_rows else None
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                         **{c: pa.array([r[k + 1] for r in rows], pa.binary()) for k, c in enumerate(("ids", "least", "sizes", "body"))}})
    return run


def _minima_rows(rows: pa.Table) -> pa.Table:
    """For each block's segments of a bucket, in its order, the smallest doc_id
    of every window, as runs."""
    number: dict[bytes, int] = {}
    ids, least, numbers = [], [], []
    for i, d, s, b in zip(*[rows.column(c).to_pylist() for c in ("ids", "least", "sizes", "body")]):
        i, d, s = _unpack_ids(i)[0].tolist(), np.frombuffer(d, dtype="<i8").tolist(), np.frombuffer(s, dtype="<u4").tolist()
        body, at, own = pa.decompress(b, decompressed_size=sum(s), codec="zstd", asbytes=True), 0, []
        for k, doc, n in zip(i, d, s):
            text = body[at:at + n]
            at += n
            m = number.get(text)
            if m is None:
                m = number[text] = len(ids)
                ids.append(k)
                least.append(doc)
            elif doc < least[m]:
                least[m] = doc
            own.append(m)
        numbers.append(own)
    texts, ids, least = list(number), np.array(ids, dtype=np.uint64), np.array(least, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    several = np.zeros(len(s), dtype=bool)
    if len(s) > 1:
        several[1:] = s[1:] == s[:-1]
        several[:-1] |= s[1:] == s[:-1]
    runs: dict[int, tuple[bytes, bytes]] = {}
    few = order[several]
    if len(few):
        for m, minima in zip(few.tolist(), window_minima([texts[m] for m in few], least[few])):
            edge = np.flatnonzero(np.concatenate([[True], minima[1:] != minima[:-1]]))
            runs[m] = np.diff(np.concatenate([edge, [len(minima)]])).astype("<u4"), minima[edge]
    out = []
    for own in numbers:
        got = [runs.get(m) for m in own]
        count = np.array([1 if g is None else len(g[0]) for g in got], dtype="<u4")
        length = np.concatenate([np.zeros(1, dtype="<u4") if g is None else g[0] for g in got])       # 0: the whole segment
        minima = np.concatenate([least[m:m + 1] if g is None else g[1] for m, g in zip(own, got)]).astype("<i8")
        counts = pa.compress(count.tobytes(), codec="lz4", asbytes=True)
        body = pa.compress(length.tobytes() + minima.tobytes(), codec="lz4", asbytes=True)
        out.append(b"".join(x.to_bytes(4, "little") for x in (len(own), len(counts), len(length))) + counts + body)
    return pa.table({"block": rows.column("block").cast(pa.int32()), "kind": pa.array([1] * len(out), pa.int32()),
                     "bucket": rows.column("bucket").cast(pa.int32()), "data": pa.array(out, pa.binary())})


def _read_minima(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, z, k = np.frombuffer(data[:12], dtype="<u4").tolist()
    count = np.frombuffer(pa.decompress(data[12:12 + z], decompressed_size=4 * n, codec="lz4", asbytes=True), dtype="<u4")
    rest = pa.decompress(data[12 + z:], decompressed_size=12 * k, codec="lz4", asbytes=True)
    return count, np.frombuffer(rest[:4 * k], dtype="<u4"), np.frombuffer(rest[4 * k:], dtype="<i8")


def remove_windows(text: bytes, covered: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the covered intervals, and the number of their maximal runs."""
    kept, at, spans = [], 0, 0
    for a, b in sorted(covered):
        if a > at or not spans:
            kept.append(text[at:a])
            spans += 1
        at = max(at, b)
    kept.append(text[at:])
    return b"".join(kept), spans


def _covered(block: Block, sizes: np.ndarray, occ: tuple, rank: np.ndarray, runs: tuple) -> dict[int, list[tuple[int, int]]]:
    """The maximal intervals to drop, by document: ``sizes`` and ``runs`` (count;
    length and smallest doc_id of each run) of the segments, in their order."""
    count, length, least = runs
    count = count.astype(np.int64)
    first = np.cumsum(count) - count
    length = np.where(length == 0, np.repeat(sizes - LENGTH + 1, count), length).astype(np.int64)
    before = np.cumsum(length) - length
    before -= np.repeat(before[first], count)                  # windows of the segment's earlier runs
    doc, start, m = occ[0], occ[1], rank[occ[2]]
    at = np.repeat(np.arange(len(doc)), count[m])
    run = np.repeat(first[m] - (np.cumsum(count[m]) - count[m]), count[m]) + np.arange(len(at))
    mine = np.array([i for i in block.doc_ids if i is not None], dtype=np.int64)
    drop = least[run] < mine[doc[at]]
    at, run = at[drop], run[drop]
    if not len(at):
        return {}
    base = np.cumsum([0] + [len(t) + 1 for t in block.texts])  # texts laid out one after another, a gap between them
    a = base[doc[at]] + start[at] + before[run]
    b = a + length[run] + LENGTH - 1
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    a, b = a[new], b[np.concatenate([new[1:] - 1, [len(b) - 1]])]
    covered: dict[int, list[tuple[int, int]]] = {}
    owner = np.searchsorted(base, a, side="right") - 1
    for d, x, y in zip(owner.tolist(), (a - base[owner]).tolist(), (b - base[owner]).tolist()):
        covered.setdefault(d, []).append((x, y))
    return covered


def _kept_rows(docs: pa.Table, answers: pa.Table) -> pa.Table:
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    if not docs.num_rows:
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
    block = Block(docs)
    covered: dict[int, list] = {}
    if answers.num_rows:
        texts, _, _, occ, rank = block.shared(*_wanted(answers))
        minima = sorted((b, d) for b, k, d in zip(*[answers.column(c).to_pylist() for c in ("bucket", "kind", "data")]) if k == 1)
        parts = [_read_minima(d) for _, d in minima]           # buckets are ranges of ids: together the block's order
        if parts:
            covered = _covered(block, np.array([len(t) for t in texts]), occ, rank,
                               tuple(np.concatenate([p[i] for p in parts]) for i in range(3)))
    rows = []
    for d, (i, t) in enumerate(zip(block.doc_ids, block.texts)):
        kept, spans = remove_windows(t, covered[d]) if d in covered else (t, 0)
        rows.append((i, len(t), len(t) - len(kept), spans, kept))
    return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds))})


def block_count(total_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / BLOCK_BYTES))


def remove_repeats(docs: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """One row per row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = block_count(total)
    buckets = BUCKETS_PER_BLOCK * blocks
    text = whole_text()
    dealt = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(blocks)).cast("int").alias("block"),
                        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).groupBy("block")
    answer = "block int, kind int, bucket int, data binary"
    shared = (dealt.applyInArrow(_minimizer_rows(buckets), "bucket int, block int, ids binary")
              .groupBy("bucket").applyInArrow(lambda rows: _shared_rows(rows, hot_segments), answer))
    minima = (dealt.cogroup(shared.groupBy("block"))
              .applyInArrow(_segment_rows(buckets), "bucket int, block int, ids binary, least binary, sizes binary, body binary")
              .groupBy("bucket").applyInArrow(_minima_rows, answer))
    return dealt.cogroup(shared.unionByName(minima).groupBy("block")).applyInArrow(
        _kept_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
