import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ulasan.llm import token_file
from ulasan.llm.catalog import QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "  two  blanks \n\n tab\t end ", "naïve café — 中文テスト 😀", "it's <|endoftext|> we'll 1234. don't.",
         "=" * 3000 + "a" * 3000, "Á é ﬁ İ", "x\x00y\x1cz　w\x85v", "a\x01b c", "l one\nl two\n\nl 3", "the cat, (and) dog's!? " * 700, "x'. a.', —. é. ²."]
SCHEMA = "doc_id long, text string, ids string, part int, first int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "clash", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_numbers_round_trip(n):
    rng = np.random.default_rng(n)
    numbers = (rng.integers(0, 2 ** 32, n, dtype=np.uint64) >> rng.integers(0, 33, n, dtype=np.uint64)).astype(np.uint32)
    control, data = token_file.pack_numbers(numbers)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in numbers)
    assert token_file.unpack_numbers(control, data, n).tolist() == numbers.tolist()


@pytest.mark.parametrize("path,end", [(BYTE, 0), (WORD, 1)])
def test_files_equal_the_library(llm, tmp_path, path, end):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aethin rs \n'!=09éñ中.,") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    lib = Tokenizer.from_file(path)
    out = str(tmp_path / "tokens")
    token_file.write_tokens(frame(llm, texts).orderBy("text"), path, out, end, block_ids=700)
    at = 0
    for i, r in enumerate(token_file.read_tokens(llm, out).orderBy("doc_id").collect()):
        ids = lib.encode(texts[i] or "", add_special_tokens=False).ids + [end]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (i, at, len(ids), crc(ids), ids)
        at += len(ids)
    assert at and i == len(texts) - 1
    blocks = llm.read.parquet(out + "/blocks").collect()
    assert len(blocks) > 8 and all(sum(b.sizes) >= 700 for b in blocks if any((b.part, b.block + 1) == (c.part, c.block) for c in blocks))
    ranks = llm.read.parquet(out + "/ranks").first()[0]
    seen = [x for t in texts for x in lib.encode(t or "", add_special_tokens=False).ids + [end]]
    count = dict(zip(*map(list, np.unique(seen, return_counts=True))))
    assert ranks == sorted(count, key=lambda x: (-count[x], x))


def test_empty_null_and_repeated_ids(llm, tmp_path):
    token_file.write_tokens(frame(llm, []), BYTE, str(tmp_path / "none"))
    assert token_file.read_tokens(llm, str(tmp_path / "none")).count() == 0
    ids = [None, 5, 5, 5, 2, None]
    token_file.write_tokens(frame(llm, ["b", "same", "same", "a", "é", "c"], ids), BYTE, str(tmp_path / "few"))
    rows = token_file.read_tokens(llm, str(tmp_path / "few")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 2, 5, 5, 5]
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])


def test_words_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(token_file, "MEMO", 20)
    with open(BYTE, encoding="utf-8") as f:
        mine = token_file.LibraryTokenizer(f.read())
    lib = Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab,", "cd", "ef!", "gh", "x"]) + rng.choice("abcdefgh.") for _ in range(12)) for _ in range(400)]
    for k in range(0, 400, 7):
        part = texts[k:k + 7]
        assert [np.frombuffer(x, "<u2").tolist() for x in mine.encode_all(part)] == [x.ids for x in lib.encode_batch(part, add_special_tokens=False)]


def test_op12_on_whole_table(llm, tmp_path):
    frame(llm, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(BYTE)
    at = 0
    for r in sorted(QUERIES["op12_token_files"](llm, str(tmp_path)).collect()):
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
