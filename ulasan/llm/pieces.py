"""Ids of whole texts by the ``tokenizers`` library, each distinct piece encoded
once and kept (operators 9 and 12).

A piece is what a byte-level BPE pattern encodes by itself: a run of letters, of
digits or of ASCII marks. Bytes are sorted into these kinds by a table, and
pieces begin where the kind changes, so a whole batch of texts is cut by a few
numpy operations; Arrow numbers the distinct pieces, and the texts' ids are
gathered from theirs at once. Plain pieces need the library's BPE model alone.
A word that holds anything else (an apostrophe, a control character, a letter
beyond U+00FF) is one piece and goes through the library's whole chain.
"""
from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .bpe import byte_alphabet

BLANK, LETTER, DIGIT, MARK, ODD = range(5)
#: UTF-8 bytes of texts that are cut together.
CHUNK = 1 << 20
#: Letters of two bytes, the first of which is 0xC3; 0x97 and 0xB7 are signs.
LEAD, SIGNS = 0xC3, (0x97, 0xB7)
PLAIN = re.compile(r" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch

KIND = np.full(256, ODD, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
KIND[33:127] = [LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else ODD if chr(c) == "'" else MARK for c in range(33, 127)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _shifted(x: np.ndarray) -> np.ndarray:
    """The value before each place; True before the first."""
    return np.concatenate([[True], x[:-1]])


def cut(raw: np.ndarray, offsets: np.ndarray, blanks: bool, lower: bool, single_digits: bool, plain: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts ``raw[offsets[i]:offsets[i + 1]]`` in UTF-8, and where
    each text's pieces begin and end. ``blanks``: white space counts: one space
    belongs to what follows it, and of a run of white space the last character
    stands apart from the others if a word follows. Otherwise white space is
    dropped. ``lower``: letters of plain words in lower case. Without ``plain``
    all words are odd."""
    kind = KIND[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    ends, first = first[1:], first[:-1]
    lead = np.flatnonzero(raw == LEAD)
    lead = lead[~np.isin(raw[lead + 1], SIGNS)]
    kind[lead] = kind[lead + 1] = LETTER
    kind[np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))] = ODD      # may begin a special token
    if not plain:
        kind[kind != BLANK] = ODD
    blank = kind == BLANK
    before = _shifted(blank)
    odd = np.flatnonzero(kind == ODD)
    data = raw
    if lower:
        data = LOWER[raw]
        data[lead + 1] += (raw[lead + 1] < 0x9F).astype(np.uint8) << 5
    if len(odd):                                            # spreads over its word
        begin = np.flatnonzero(~blank & (first | before))
        end = np.flatnonzero(~blank & (ends | np.concatenate([blank[1:], [True]])))
        word = np.unique(np.searchsorted(begin, odd, "right") - 1)
        size = end[word] + 1 - begin[word]
        at = np.repeat(begin[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
        kind[at] = ODD
        if lower:
            data[at] = raw[at]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    if single_digits:
        change |= kind == DIGIT
    if blanks:
        space = _shifted(raw == ord(" "))
        space[first] = False
        change &= ~(space & ~blank)                         # the space before begins the piece
        last = blank & ~ends
        last[:-1] &= ~blank[1:]
        change |= last
    else:
        change &= ~blank
    border = np.searchsorted(np.flatnonzero(change), offsets)
    if not blanks:
        data, change = data[~blank], change[~blank]
    begin = np.append(np.flatnonzero(change), len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(np.ascontiguousarray(data))), border


class PieceTokenizer:
    """Ids of texts by the library, piece by piece. ``memo``: pieces kept in a
    worker; when there are more, it begins anew with those of the current texts."""

    def __init__(self, lib, dtype: np.dtype, memo: int, plain: bool, **rules: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        self.lib, self.dtype, self.memo, self.plain, self.rules = lib, dtype, memo, plain, rules
        self.alphabet = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        tokens, ids, ends, place = self.lib.model.tokenize, self.ids, self.ends, self.place
        rest = []
        for x in pieces:
            if self.plain and PLAIN(x):
                if x.isascii():
                    found = tokens("Ġ" + x[1:] if x[0] == " " else x)
                else:
                    found = tokens("".join([self.alphabet[b] for b in x.encode()]))
                ids.extend([t.id for t in found])
                place[x] = len(place)
                ends.append(len(ids))
            else:
                rest.append(x)
        for x, found in zip(rest, self.by_library(rest)):
            ids.extend(found)
            place[x] = len(place)
            ends.append(len(ids))

    def gather(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one behind the other, and where each begins
        and ends."""
        found = pieces.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = list(map(self.place.get, distinct))
        if None in at:
            missing = [x for x, k in zip(distinct, at) if k is None]
            if len(self.place) + len(missing) > self.memo:
                self.forget()
                missing = distinct
            self._learn(missing)
            at = list(map(self.place.get, distinct))
        at = np.array(at, dtype=np.int64)[found.indices.to_numpy()]
        ends = np.frombuffer(self.ends, dtype=np.int64)
        size = ends[at + 1] - ends[at]
        border = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(ends[at] - border[:-1], size) + np.arange(border[-1])
        return np.frombuffer(self.ids, dtype=np.uint32)[where].astype(self.dtype), border

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text (see ``utf8``), as little-endian integers of ``dtype``."""
        out: list[bytes] = []
        cuts = np.flatnonzero(np.diff(offsets // CHUNK)) + 1
        cuts = np.unique(np.concatenate([[0], cuts, [len(offsets) - 1]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            a, b = offsets[i], offsets[j]
            if a == b:
                out += [b""] * (j - i)
                continue
            pieces, border = cut(raw[a:b], offsets[i:j + 1] - a, plain=self.plain, **self.rules)
            ids, ends = self.gather(pieces)
            data = ids.tobytes()
            border = (ends[border] * self.dtype.itemsize).tolist()
            out += [data[x:y] for x, y in zip(border, border[1:])]
        return out
