import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ulasan.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a", "  two  blanks \n\n tab\t end ", "naïve café — 中文テスト 😀", "it's <|endoftext|> we'll 1234",
         "=" * 3000 + "a" * 3000, "Á é ﬁ İ", "x\x00y\x1cz　w", "the cat " * 500]
SCHEMA = "doc_id long, text string, ids string, extra int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(3)
    return TEXTS + ["".join(rng.choice("aethin rs \n'!=09éñ中") for _ in range(rng.randint(0, 80))) for _ in range(400)]


def test_bpe_equals_library_and_round_trips(llm, random_texts):
    lib = Tokenizer.from_file(BYTE)
    vocab = bpe.vocabulary(llm, BYTE)
    out = bpe.bpe_decode(bpe.bpe_encode(frame(llm, random_texts), vocab), vocab).collect()
    assert len(out) == len(random_texts)
    for r in out:
        t = random_texts[r.doc_id] or ""
        assert list(r.ids) == lib.encode(t, add_special_tokens=False).ids
        assert r.decoded == lib.decode(list(r.ids), skip_special_tokens=False) and r.extra == r.doc_id


def test_bpe_decode_odd_ids(llm):
    vocab = bpe.vocabulary(llm, BYTE)
    df = llm.createDataFrame([(1, [464, 99999999, -5, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.bpe_decode(df, vocab).collect()} == {1: "The<|endoftext|>", 2: "", 3: ""}


def test_empty_table(llm):
    from ulasan.llm.q_tokens import pack_documents
    vocab = bpe.vocabulary(llm, BYTE)
    assert bpe.bpe_decode(bpe.bpe_encode(frame(llm, []), vocab), vocab).count() == 0
    assert pack_documents(frame(llm, []), WORD).count() == 0


def test_op1_on_whole_table(llm, tmp_path):
    from ulasan.llm.catalog import QUERIES
    frame(llm, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(BYTE)
    for r in QUERIES["op1_bpe_encode_decode"](llm, str(tmp_path)).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def check_packing(rows, texts, window=2048):
    lib = Tokenizer.from_file(WORD)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    covered, windows = {i: [] for i in ids}, {}
    for r in rows:
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4").tobytes()
        assert len(own) == 4 * r.length and r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, got in covered.items():
        at = 0
        for s, n in sorted(got):
            assert s == at
            at += n
        assert at == len(ids[i])
    padding = total = 0
    for got in windows.values():
        at = 0
        for o, n in sorted(got):
            assert o == at and n > 0
            at += n
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, total


def test_packing_covers_every_id_once(llm, random_texts):
    rows = packing.pack_documents(frame(llm, random_texts).coalesce(1), WORD).collect()
    padding, total = check_packing(rows, random_texts)
    assert padding < 2048


def test_packing_small_blocks_and_groups(llm, random_texts):
    rows = packing.pack_documents(frame(llm, random_texts).repartition(3), WORD, block_tokens=500, step_tokens=4096).collect()
    check_packing(rows, random_texts)


def test_pack_fills_windows():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.choice([1, 7, 60, 300, 2048, 5000, rng.randint(1, 4000)]) for _ in range(rng.randint(0, 80))]
        open_windows = [sum(p[2] for p in w) for _, w in packing.pack(lengths) if sum(p[2] for p in w) != 2048]
        assert sum(open_windows) < 2048
        assert sum(1 for n in open_windows if n & (n - 1)) <= 1
    sizes = [2048] * 100 + [64] * 3
    groups = packing.step_groups(sizes, 20480)
    sums = [sum(s for s, g in zip(sizes, groups) if g == k) for k in range(max(groups) + 1)]
    assert max(sums) - min(sums) <= 2048


def test_pack_routes_to_tiers():
    rng = random.Random(9)
    tiers = packing.tier_sizes()
    assert tiers == [2048, 1024, 512, 256, 128, 64]
    # nothing longer than 1000 tokens: no window above 1024 is opened
    assert {t for t, _ in packing.pack([600] * 50 + [1000] * 50, tiers=tiers) if t > 1024} == set()
    # 1500 opens a long window, its gap of 548 takes 300 and 200 of shorter tiers' shelves, and 48 of a cut one
    first = packing.pack([300, 1500, 200, 60, 90, 90], tiers=tiers)[0]
    assert first == (2048, [(1, 0, 1500), (0, 0, 300), (2, 0, 200), (3, 0, 48)])
    for _ in range(50):
        lengths = [rng.choice([1, 7, 60, 300, 2048, 5000, rng.randint(1, 4000), rng.randint(1, 200)]) for _ in range(rng.randint(0, 300))]
        windows = packing.pack(lengths, tiers=tiers)
        parts = sorted(p for _, w in windows for p in w)
        at = [0] * len(lengths)
        for doc, start, n in parts:
            assert start == at[doc] and n > 0
            at[doc] += n
        assert at == lengths
        open_windows = [t for t, w in windows if sum(p[2] for p in w) != t]
        assert {t for t, _ in windows} <= set(tiers) and open_windows in ([], [64])
    lengths = [rng.choice([40, 40, 40, 90, 90, 200, 200, 200, 400, 400, 800, 1500]) for _ in range(4000)]
    counts = {t: sum(1 for x, _ in packing.pack(lengths, tiers=tiers) if x == t) for t in tiers}
    assert all(counts[t] > 100 for t in (2048, 1024, 512, 256))


def test_packing_gives_several_tiers(llm):
    texts = ["the cat " * n for n in [20] * 60 + [45] * 40 + [100] * 40 + [200] * 40 + [400] * 20 + [700] * 4]
    rows = packing.pack_documents(frame(llm, texts).coalesce(1), WORD).collect()
    padding, _ = check_packing(rows, texts)
    assert padding < 2048
    size = {}
    for r in rows:
        size.setdefault((r.sequence_id, r.tier), []).append(r.length)
    assert len({t for _, t in size} & {2048, 1024, 512, 256}) >= 3
    assert [t for (_, t), n in size.items() if sum(n) != t] in ([], [64])
    # a document of more than half its tier stands in a window of that tier or fills a longer one
    assert all(r.tier >= r.length for r in rows)
