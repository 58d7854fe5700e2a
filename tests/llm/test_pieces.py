"""Pieces cut by bytes give the library's ids."""
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ulasan.llm import packing, pieces, token_file
from ulasan.llm.common import utf8

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = list("abcXYZtsre  \n\n'.,!?<|>012é") + [
    " '", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "É", "ß", "÷", "×", "Þ", "ÿ", "\t", "\r", "\x0b", "\x0c", "\x00",
    "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", " ", " ", " ", "　", "​", "́", "中", "文", "😀", "ﬁ", "İ",
    "Σ", "ſ", "²", "½", "Á", "Å", "ª", "µ", "—", "’", "the ", " and"]


def batch(texts):
    return utf8(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text")


@pytest.mark.parametrize("path,kind", [(BYTE, token_file.LibraryTokenizer), (WORD, packing.WordTokenizer)])
@pytest.mark.parametrize("chunk,memo", [(1 << 20, 700_000), (200, 30)])
def test_ids_equal_the_library(monkeypatch, path, kind, chunk, memo):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        mine = kind(f.read())
    mine.memo = memo
    rng = random.Random(chunk)
    for _ in range(15):
        texts = []
        for _ in range(200):
            some = rng.sample(SIGNS, rng.choice([5, 24, 30, len(SIGNS)]))
            texts.append("".join(rng.choice(some) for _ in range(rng.choice([0, 1, 3, 10, 40]))))
        got = [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode(*batch(texts))]
        assert got == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
        assert len(mine.place) <= max(memo, 5000)
    assert mine.encode(*batch([])) == [] and mine.encode(*batch(["", ""])) == [b"", b""]


def test_other_patterns_go_to_the_library():
    with open(WORD, encoding="utf-8") as f:
        spec = f.read().replace("|[\\\\p{N}]|", "|[\\\\p{N}]+|")
    mine, lib = packing.WordTokenizer(spec), Tokenizer.from_str(spec)
    assert not mine.plain
    texts = ["the year 2021, and X-rays", "12 monkeys"]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(*batch(texts))] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_texts_of_plain_words_need_the_model_alone(monkeypatch):
    """Before, each new word went through the library's normalizer, pattern and model."""
    texts = ["Plain words, of letters and 1234 signs. Étude für él."] * 3
    for path, kind in ((BYTE, token_file.LibraryTokenizer), (WORD, packing.WordTokenizer)):
        with open(path, encoding="utf-8") as f:
            mine = kind(f.read())
        sent = []
        monkeypatch.setattr(mine, "by_library", lambda x, sent=sent: sent.extend(x) or [])
        assert len(mine.encode(*batch(texts))) == 3 and sent == []
