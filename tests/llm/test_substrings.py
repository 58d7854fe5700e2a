import random

import numpy as np

from conftest import SF01
from ulasan.llm import substring_dedup as sd
from ulasan.llm.suffix import common_prefixes, suffix_array


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for t in range(150):
        x = bytes(rng.choice(rng.choice([b"ab", b"abc\x00\xff", bytes(range(256))])) for _ in range(rng.randint(1, 200)))
        x = x * 3 if t % 5 == 0 else x + b"a" * 100 + x if t % 7 == 0 else x
        a, depth = np.frombuffer(x, dtype=np.uint8), rng.choice([20, 50])
        order = suffix_array(a, depth)
        cut = [x[i:i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(x))) and cut == sorted(cut)
        for i, n in enumerate(common_prefixes(a, order, depth)[1:], 1):
            p, q = x[order[i - 1]:], x[order[i]:]
            assert n == next((k for k in range(min(len(p), len(q), depth)) if p[k] != q[k]), min(len(p), len(q), depth))


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p:p + 50]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        drop = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p:p + 50]] < i:
                    drop[p:p + 50] = b"\x01" * 50
        spans = sum(1 for p in range(len(b)) if drop[p] and (p == 0 or not drop[p - 1]))
        out.append((str(i), len(b), sum(drop), spans, bytes(c for c, d in zip(b, drop) if not d)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(df).collect())


def make_rows():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé 中") for _ in range(rng.randint(30, 160))) for _ in range(12)]
    def text():
        out = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            out.append(rng.choice([p, p[a:], p[:-a or None], "".join(rng.choice("xyz") for _ in range(rng.randint(1, 90))), " spam" * 30, "=" * 120]))
        return "".join(out)
    rows = [(rng.randint(-50, 400), text()) for _ in range(150)]
    base = "".join(rng.choice("qwertyuiop ") for _ in range(400))
    rows += [(1000 + i, base[:i * 7] + "#" + base[i * 7:]) for i in range(40)] + [(2000 + i, base) for i in range(30)]
    return rows + [(3000, None), (3001, ""), (None, base), (None, None), (3002, "z" * 49), (3003, "z" * 50), (3004, "z" * 51), rows[0], rows[7], (3005, "long passage " * 6000)]


def test_repeats_equal_brute_force(llm, monkeypatch):
    rows = make_rows()
    df = llm.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    want = brute(rows)
    assert got(df.repartition(4)) == want
    assert sum(w[2] for w in want) > 5000
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_repeats_on_the_documents_table(llm):
    df = llm.read.parquet(f"{SF01}/documents.parquet").where("n_chars < 3000")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(df) == brute(rows)


def hot_rows():
    """A phrase of 30 bytes and a passage, each document with its own context."""
    rng = random.Random(6)
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(70))
    passage = "".join(rng.choice("qrstuvw ") for _ in range(120))
    return [(i, own() + "THE PHRASE THEY HAVE IN COMMON" + own() + passage + own()) for i in range(60)] + make_rows()[:40]


def test_hot_minimizers_equal_brute_force(llm):
    rows = hot_rows()
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (4, 0):
        out = sd.remove_repeats(df, hot_segments=hot).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == brute(rows)


def test_several_blocks_equal_brute_force_and_follow_the_bytes(llm, monkeypatch):
    rows = hot_rows()
    df = llm.createDataFrame(rows, "doc_id long, text string")
    total = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(sd, "BLOCK_BYTES", total // 9)
    assert sd.block_count(total) in (9, 10) and sd.block_count(0) == 1
    assert got(df) == brute(rows)
    import pyarrow as pa
    docs = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "block": [3] * len(rows)})
    sent, entries = sd._minimizer_rows(10 ** 4)(docs), len(sd.Block(docs).minimizers()[0])
    assert sent.num_rows <= entries == sum(len(x) // 7 for x in sent.column("ids").to_pylist())


def test_hot_minimizers_are_split():
    """No id brings more than a few distinct segments to one suffix array."""
    import pyarrow as pa
    rows = hot_rows()
    docs = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "block": [0] * len(rows)})
    most = {}
    for bound in (10, 1 << 40):
        sent = sd._shared_rows(pa.table({"bucket": [0], "block": [0], "ids": [sd._minimizer_rows(1)(docs).column("ids")[0].as_py()]}), bound)
        _, ids, _, _, _ = sd.Block(docs).shared(*sd._wanted(sent))
        most[bound] = int(np.unique(ids, return_counts=True)[1].max())
    assert most[1 << 40] >= 50 and most[10] <= 10
