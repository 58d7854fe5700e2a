import hashlib
import random

from pyspark.sql import functions as F

from ulasan.llm import fingerprint as fp
from ulasan.llm.catalog import QUERIES


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_likeness_estimates_jaccard(llm):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(4000)]
    pairs = []
    for n in (3, 12, 60, 250, 1500):
        for keep in (0, 0.3, 0.5, 0.8, 0.95, 1):
            a = [rng.choice(vocab) for _ in range(n)]
            b = a[:int(n * keep)] + [rng.choice(vocab) for _ in range(n - int(n * keep))]
            pairs.append((" ".join(a), " ".join(b)))
    df = llm.createDataFrame(pairs, "a string, b string").withColumn("x", fp.fingerprint(F.col("a"))).withColumn("y", fp.fingerprint(F.col("b")))
    errors = []
    for r in df.withColumn("s", fp.likeness(F.col("x"), F.col("y"))).collect():
        sa, sb = shingles(r.a), shingles(r.b)
        errors.append(abs(r.s - len(sa & sb) / len(sa | sb)))
        assert len(r.x) == 16
        if r.a == r.b:
            assert r.x == r.y and r.s == 1.0
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.04


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((str(i), len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return sorted(out)


def test_next_document_and_edge_cases(llm, tmp_path):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice("ab cdé 中😀 efg hi".split()) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(9, "same id"), (357, "top twice"), (357, None), (None, "no id"), (1000, ""), (1001, "  \t"), (1002, "long " * 20000)]
    df = llm.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(4)
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    out = QUERIES["op6_document_fingerprint"](llm, str(tmp_path / "a")).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert {r.fingerprint for r in out if r.doc_id in (1000, 1001)} == {""}


def test_one_row_and_none(llm, tmp_path):
    df = llm.createDataFrame([(5, "only one document is here")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "b/documents.parquet"))
    r, = QUERIES["op6_document_fingerprint"](llm, str(tmp_path / "b")).collect()
    assert r.near_next == 1.0
    df.limit(0).write.parquet(str(tmp_path / "c/documents.parquet"))
    assert QUERIES["op6_document_fingerprint"](llm, str(tmp_path / "c")).count() == 0
