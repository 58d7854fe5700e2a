"""Hierarchical multi-length packing (operator 9).

Documents become token ids (by the ``tokenizers`` library, one end id behind
each) and are packed into windows. The tiers are context sizes, powers of two
from ``window`` down to ``least_tier``; each has a shelf of remainders:

1. Routing: a document's full windows are cut off its front and stand alone;
   what remains goes to the shelf of the smallest tier that holds it.
2. Each tier is packed into windows of its own size, the longest tier first and
   each from its longest remainders downwards: a remainder opens a window, and
3. gaps are filled from the shelves of the same and shorter tiers, by the
   longest remainder that fits. When none fits, the shortest one there is cut so
   that the window is exactly full; its rest goes to the tier that holds it.
4. A window stays open only when no remainder is left, so it is the last one of
   its block. Its tokens are cut into windows of shorter tiers (the binary digits
   of its length), and what is below ``least_tier`` alone is padded up to it.
5. Step groups: the block's windows are dealt to step groups of about equal
   token counts, longest first, each to the lightest group.

Everything happens in one ``mapInArrow`` without a shuffle: a task packs its
documents in blocks of at least ``block_tokens`` ids, so memory is bounded by
the block and the longest text, and a lost task repeats the same blocks. Only
each block's last window can be padded.

Edge cases: a NULL text is an empty one (one piece with the end id alone);
repeated rows are packed once each; an empty table gives an empty result; a
NULL doc_id is packed and stays NULL; other columns are not read.
"""
from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8, whole_text
from .pieces import PieceTokenizer

WINDOW = 2048
#: Windows of fewer tokens than this are padded rather than cut further.
LEAST_TIER = 64
BLOCK_TOKENS = 1 << 21
#: Tokens that one step takes.
STEP_TOKENS = 64 * WINDOW
END_ID = 1
#: Pieces kept with their ids in each worker.
MEMO = 700_000

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("step_group", T.LongType()),
])


#: Normalizer and split pattern of the vocabularies whose plain words are cut into pieces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer(PieceTokenizer):
    """Ids of a text by the library, piece by piece: this kind of vocabulary
    drops white space and never joins across it. With another normalizer or
    pattern than the known ones, whole words go to the library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_str(spec)
        lib.no_truncation()
        lib.no_padding()
        said = json.loads(spec)
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = ((said.get("normalizer") or {}).get("normalizers") == NORMALIZERS and len(steps) == 2
                 and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": PATTERN}, "Removed", True)
                 and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False))
        super().__init__(lib, np.dtype("<u4"), MEMO, known, blanks=False, lower=True, single_digits=True)


class _Shelf:
    """Remainders by length; takes the longest that fits, or the shortest."""

    def __init__(self):
        self.lengths: list[int] = []
        self.at: dict[int, list] = {}

    def add(self, n: int, piece) -> None:
        if n not in self.at:
            self.at[n] = []
            insort(self.lengths, n)
        self.at[n].append(piece)

    def take(self, most: int):
        """A piece of the longest length up to ``most``, else None."""
        k = bisect_right(self.lengths, most)
        return self._pop(k - 1) if k else None

    def shortest(self):
        return self._pop(0) if self.lengths else None

    def _pop(self, k: int):
        n = self.lengths[k]
        piece = self.at[n].pop()
        if not self.at[n]:
            del self.at[n], self.lengths[k]
        return n, piece


def tier_sizes(window: int = WINDOW, least_tier: int = LEAST_TIER) -> list[int]:
    """Context sizes, longest first: ``window`` and its halves down to ``least_tier``."""
    out = [window]
    while out[-1] % 2 == 0 and out[-1] // 2 >= least_tier:
        out.append(out[-1] // 2)
    return out


def pack(lengths: list[int], window: int = WINDOW, least_tier: int = LEAST_TIER,
         tiers: list[int] | None = None) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows ``(tier, [(document, start, length), ...])`` for documents of
    these lengths (all at least 1). ``tiers``: the sizes that windows are opened
    with, longest first; by default ``window`` alone. The operator gives all of
    ``tier_sizes``."""
    tiers = [window] if tiers is None else tiers
    shelves = [_Shelf() for _ in tiers]
    upwards = tiers[::-1]

    def holding(n: int) -> int:
        """The smallest tier that holds ``n`` tokens, as its place in ``tiers``."""
        return len(tiers) - 1 - bisect_left(upwards, n)

    def fitting(room: int):
        """The longest remainder up to ``room``, else None."""
        for k in range(holding(room), len(tiers)):
            fit = shelves[k].take(room)
            if fit is not None:
                return fit
        return None

    def shortest(first: int):
        """The shortest remainder of tier ``first`` and the shorter ones, else None."""
        for k in range(len(tiers) - 1, first - 1, -1):
            if shelves[k].lengths:
                return shelves[k].shortest()
        return None

    windows = []
    for doc, n in enumerate(lengths):
        full = n // window * window
        windows += [(window, [(doc, s, window)]) for s in range(0, full, window)]
        if n > full:
            shelves[holding(n - full)].add(n - full, (doc, full))
    for k, tier in enumerate(tiers):
        while shelves[k].lengths:
            n, (doc, start) = shelves[k].take(tier)   # the tier's longest left opens a window
            got, room = [(doc, start, n)], tier - n
            while room:
                fit = fitting(room)
                if fit is None:                       # cut the shortest to fill the gap
                    cut = shortest(k)
                    if cut is None:
                        break
                    n, (doc, start) = cut
                    got.append((doc, start, room))
                    shelves[holding(n - room)].add(n - room, (doc, start + room))
                    room = 0
                else:
                    n, (doc, start) = fit
                    got.append((doc, start, n))
                    room -= n
            if not room:
                windows.append((tier, got))
            else:
                windows += _smaller_tiers(got, tier - room, tier, least_tier)
    return windows


def _smaller_tiers(pieces: list[tuple[int, int, int]], total: int, window: int, least_tier: int) -> list:
    """Cut an open window's pieces along the binary digits of its length."""
    out, sizes = [], tier_sizes(window, least_tier)
    while total:
        tier = next((t for t in sizes if t <= total), sizes[-1])
        take = min(tier, total)
        got, need = [], take
        while need:
            doc, start, n = pieces.pop(0)
            if n > need:
                pieces.insert(0, (doc, start + need, n - need))
                n = need
            got.append((doc, start, n))
            need -= n
        out.append((tier, got))
        total -= take
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window, with about equal sums."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        total, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (total + sizes[i], g))
    return out


_WORKER: dict[tuple, WordTokenizer] = {}


def pack_documents(df: DataFrame, vocab_path: str, window: int = WINDOW, least_tier: int = LEAST_TIER,
                   block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of ``df`` (doc_id, text): its ids ``[start, start +
    length)`` stand at ``offset`` of ``sequence_id``. ``tier`` is the window's
    size, padding included."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())     # the vocabulary file: a fixed size

    def block(doc_ids: list, ids: list[bytes], at: int, group0: int) -> pa.RecordBatch:
        windows = pack([len(x) // 4 for x in ids], window, least_tier, tier_sizes(window, least_tier))
        groups = step_groups([sum(p[2] for p in w[1]) for w in windows], step_tokens)
        rows = []
        for i, (tier, pieces) in enumerate(windows):
            offset = 0
            for doc, start, n in pieces:
                rows.append((doc_ids[doc], start, n, zlib.crc32(ids[doc][4 * start:4 * (start + n)]), len(ids[doc]) // 4,
                             at + i, offset, tier, group0 + groups[i]))
                offset += n
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=SCHEMA.names), len(windows), max(groups) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocab_path, len(spec.value))
        if key not in _WORKER:
            _WORKER[key] = WordTokenizer(spec.value)
        encode, end = _WORKER[key].encode, np.array([END_ID], dtype="<u4").tobytes()
        at = group0 = TaskContext.get().partitionId() << 33
        docs, ids, held = [], [], 0
        for batch in batches:
            docs += batch.column(0).to_pylist()
            new = [x + end for x in encode(*utf8(batch, "text"))]
            ids += new
            held += sum(map(len, new)) // 4
            if held >= block_tokens:
                out, n, g = block(docs, ids, at, group0)
                yield out
                at, group0, docs, ids, held = at + n, group0 + g, [], [], 0
        if docs:
            yield block(docs, ids, at, group0)[0]

    return df.select(df["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, SCHEMA)
