"""Byte-level BPE encoding and decoding (operator 1).

Encoder: the text is cut by the vocabulary's pattern, and each piece is encoded
by backtracking. An Aho-Corasick automaton over all tokens gives the longest
token that starts at every byte of the piece. The encoder goes from left to
right and takes the longest token that may follow the previous one; where none
may, it marks the position as a dead end, drops the previous token and tries
that token's next shorter prefix. Whether two tokens may stand side by side is
a property of the pair alone (their concatenation must not merge across the
border), kept in a pair table. Each position is marked at most once, so the
work is linear in the piece, and the result equals applying the merges in rank
order.

Decoder: all token bytes stand in one buffer; an offset table gives each
token's place, so decoding is one gather.

The vocabulary has a fixed size (some megabytes) and is broadcast; texts stream
through ``mapInArrow`` in small batches, without a shuffle.

Edge cases: NULL text counts as empty and gives no ids; NULL ids decode to the
empty text; ids outside the vocabulary are skipped; special tokens written in a
text become their ids, as the file's own tokenizer does. Repeated rows and
extra columns pass through (the operators add one column, replacing a column of
that name).
"""
from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed value: the split pattern of byte-level BPE vocabularies of this kind ---
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ----------------------------------------------------------------------------------

#: Words kept with their ids in each worker, in two generations of this size:
#: when the young one is full it becomes the old one, and the old one goes.
MEMO = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_vocabulary(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file, as plain values."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}

    def raw(token: str) -> bytes:
        return bytes(byte_of[c] for c in token)

    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {"vocab": vocab, "merges": [(raw(a), raw(b)) for a, b in pairs], "special": special}


class Encoder:
    """Backtracking encoder; inside, tokens are numbered by merge rank."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        vocab = spec["vocab"]
        pieces = [bytes([b]) for b in range(256)]
        parts = [(b, b) for b in range(256)]
        number = {p: i for i, p in enumerate(pieces)}
        for a, b in spec["merges"]:
            if a + b not in number:
                number[a + b] = len(pieces)
                parts.append((number[a], number[b]))
                pieces.append(a + b)
        self.parts = parts
        self.merged = {}
        for token in range(256, len(pieces)):
            self.merged[parts[token]] = token
        self.ids = [vocab.get(p, -1) for p in pieces]
        self.size = [len(p) for p in pieces]
        self.shorter = [self._shorter(p, number) for p in pieces]
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.tokens = self._make_tokens()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.findall = regex.compile(PATTERN).findall
        self.odd_blank = regex.compile(r" (?!\S)").search
        self.blanks = regex.compile(r"(?<=.)(?= \S)", regex.S | regex.V1).split
        self.special = spec["special"]
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @staticmethod
    def _shorter(piece: bytes, number: dict[bytes, int]) -> int:
        for n in range(len(piece) - 1, 0, -1):
            if piece[:n] in number:
                return number[piece[:n]]
        return -1

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges of ``left + right`` end with just these two tokens:
        undo the later of the two merges, again and again, and look for an
        earlier merge across the border."""
        a, b, limit = left, right, len(self.parts) + 1
        answer = True
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < limit:
                answer = False
                break
            if a > b or (a == b and a < 256):
                if a < 256:
                    break
                limit, a = a, self.parts[a][1]
            elif b >= 256:
                limit, b = b + 1, self.parts[b][0]
            else:
                break
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[left << 20 | right] = answer
        return answer

    def _make_tokens(self):
        size, shorter, may_follow = self.size, self.shorter, self.may_follow
        matches, known = self.automaton.iter, self.pairs.get

        def tokens(piece: bytes) -> list[int]:
            """The merge ranks of the piece's tokens."""
            n = len(piece)
            longest = [0] * n
            for end, token in matches(piece.decode("latin-1")):
                longest[end + 1 - size[token]] = token   # later ends are longer
            last = longest[0]
            at = size[last]
            out = [last]
            if at == n:
                return out
            token, dead = longest[at], set()
            while at < n:
                end = at + size[token]
                if end in dead:
                    fits = False
                elif out:
                    fits = known(last << 20 | token)
                    if fits is None:
                        fits = may_follow(last, token)
                else:
                    fits = True
                if fits:
                    out.append(token)
                    last, at = token, end
                    if at < n:
                        token = longest[at]
                elif shorter[token] >= 0:
                    token = shorter[token]
                else:
                    dead.add(at)
                    token = out.pop()
                    at -= size[token]
                    last = out[-1] if out else -1
            return out

        return tokens

    def _learn(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            ids = [self.ids[t] for p in self.findall(word) for t in self.tokens(p.encode("utf-8"))]
            if -1 in ids:
                raise ValueError(f"the vocabulary has no token for a part of {word[:200]!r}")
            found = array("i", ids).tobytes()
        if len(self.memo) >= MEMO:
            self.old, self.memo = self.memo, {}
        if len(word) <= 64:
            self.memo[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        """The pattern always begins a piece at a space before a visible
        character, so words cut there can be encoded, and kept, one by one."""
        if self.odd_blank(text):
            words = self.blanks(text)
        else:
            first, *rest = text.split(" ")
            words = [first] + [" " + w for w in rest]
        get, learn = self.memo.get, self._learn
        return b"".join([get(w) or learn(w) for w in words])

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else self._plain(p)
                        for p in self.cut.split(text) if p)


class Decoder:
    """All token bytes in one buffer, with an offset table by id."""

    def __init__(self, spec: dict):
        of = {i: p for p, i in spec["vocab"].items()} | {i: t.encode("utf-8") for t, i in spec["special"].items()}
        top = max(of, default=-1) + 1
        self.buffer = np.frombuffer(b"".join(of.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(of.get(i, b"")) for i in range(top)])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        if not len(ends):
            return ""
        place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.buffer[place].tobytes().decode("utf-8", "replace")


_WORKER: dict[tuple, object] = {}


def _own(kind: type, spec) -> object:
    """One encoder or decoder per worker process and vocabulary."""
    key = (kind.__name__, spec.value["key"])
    if key not in _WORKER:
        _WORKER[key] = kind(spec.value)
    return _WORKER[key]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values],
                                      names=[batch.schema.names[i] for i in keep] + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType, drop: str | None = None) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in (name, drop)] + [T.StructField(name, kind)])


def vocabulary(spark, path: str):
    """The file's tables, broadcast; their size is that of the vocabulary."""
    spec = read_vocabulary(path)
    spec["key"] = (path, len(spec["vocab"]), len(spec["merges"]))
    return spark.sparkContext.broadcast(spec)


def bpe_encode(df: DataFrame, vocab, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Adds ``ids array<int>``: the token ids of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _own(Encoder, vocab).encode
        for batch in batches:
            found = [encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
            if not keep_text:
                batch = batch.drop_columns([text])
            yield _with_column(batch, ids, lists)

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType()), None if keep_text else text))


def bpe_decode(df: DataFrame, vocab, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _own(Decoder, vocab).decode
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            flat = col.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0] + [n or 0 for n in col.value_lengths().to_pylist()])
            out = [decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield _with_column(batch, text, pa.array(out, pa.string()))

    return df.mapInArrow(run, _schema(df, text, T.StringType()))
