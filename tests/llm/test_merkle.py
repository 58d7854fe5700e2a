import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from ulasan.llm import merkle
from ulasan.llm.catalog import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int, pos int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(s):
    return sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, i, fanout):
    """Root of the list of nodes, and the path of node i."""
    path = []
    while len(nodes) > 1:
        first = i - i % fanout
        path.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + fanout])))
        nodes, i = [H("".join(nodes[k:k + fanout])) for k in range(0, len(nodes), fanout)], i // fanout
    return nodes[0], path


def brute(rows, fanout=2):
    trees = {}
    for d, text, lang, source, n, *_ in rows:
        leaf, bad = (H("".join(map(enc, (d, source, lang, m, text)))) for m in (n, None if n is None else n + 1))
        trees.setdefault(b"" if lang is None else b"=" + lang.encode(), []).append((d is not None, d or 0, leaf, d, bad))
    names = sorted(trees)
    for v in trees.values():
        v.sort()
    subroots = [climb([x[2] for x in trees[k]], 0, fanout)[0] for k in names]
    out = []
    for t, name in enumerate(names):
        root, top = climb(subroots, t, fanout)
        for i, (_, _, leaf, d, bad) in enumerate(trees[name]):
            path = climb([x[2] for x in trees[name]], i, fanout)[1] + top
            at = bad if d is not None and crc32(str(d).encode()) % 7 == 0 else leaf
            for before, after in path:
                at = H(before + at + after)
            out.append((d, leaf, subroots[t], root, H("".join(a + b for a, b in path)), at, at == root))
    return sorted(out, key=repr)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    langs = ["en"] * 8 + ["fr", "é", "", None, "zz"]
    rows = [(i, rng.choice([None, "", f"text é {i}", "x" * 5000]), rng.choice(langs), rng.choice(["a", None]),
             rng.choice([None, i]), "clash", 1, 2) for i in range(n)]
    return rows + [rows[3]] * 3 + [(None, "t", "en", "s", 4, "clash", 1, 2)] * 2 if n > 3 else rows


def manifest(spark, rows, fanout, block):
    df = spark.createDataFrame(rows, SCHEMA)
    out = merkle.merkle_manifest(merkle.document_leaves(df), ["doc_id"], ["doc_id", "tampered"], fanout, block)
    from pyspark.sql import functions as F
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))).withColumn(
        "verified", F.expr("folded_root = root")).withColumn("proof_sha256", merkle.proof_digest(F.col("proof")))
    return sorted(map(tuple, out.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("n,fanout,block", [(150, 2, 4), (61, 3, 1), (1, 2, 4)])
def test_equals_the_whole_trees(llm, n, fanout, block):
    rows = rows_of(n, n)
    assert manifest(llm, rows, fanout, block) == brute(rows, fanout)


def test_empty_table(llm):
    assert manifest(llm, [], 2, 4) == []


def test_query_on_odd_rows(llm, tmp_path):
    rows = rows_of(120)
    llm.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(tuple, QUERIES["op11_merkle_manifest"](llm, str(tmp_path)).select(COLUMNS).collect()), key=repr)
    assert found == brute(rows) and not all(r[-1] for r in found)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ", ".join(COLUMNS)
    assert sorted(con.execute(f"SELECT {names} FROM ({ORACLE['op11_merkle_manifest']})").fetchall(), key=repr) == found


def test_one_id_on_most_rows(llm):
    """Equal rows are spread over partitions and still get places of their own."""
    rows = [(7, "same", "en", "s", 1, "c", 1, 2)] * 300 + rows_of(50)
    assert manifest(llm, rows, 2, 8) == brute(rows)
