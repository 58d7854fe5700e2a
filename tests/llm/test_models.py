import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from ulasan.llm import neighbours, quality
from ulasan.llm.catalog import QUERIES


def test_neighbours_recall_and_exact_scores(llm):
    rows = llm.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    at = {i: k for k, i in enumerate(ids)}
    got = QUERIES["op5_nearest_neighbours"](llm, SF01).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[at[q]]) ** 2).sum(1))
        want = [i for _, i in sorted((v, i) for v, i in zip(d, ids) if i != q)][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [s for *_, s in mine] == sorted(s for *_, s in mine)
        assert all(abs(s - d[at[v]]) < 1e-12 for _, v, s in mine)
        hits, total = hits + len(set(want) & {v for _, v, _ in mine}), total + len(want)
    assert hits / total >= 0.9


def test_neighbours_edge_cases(llm):
    nan = float("nan")
    rows = [(i, [1.0, float(i % 3)]) for i in range(0, 900, 50)]
    rows += [(1000, None), (1100, [0.0, 0.0]), (1200, [nan, 1.0]), (1300, [None, 1.0]), (1400, [float("inf"), 1.0]), (1500, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(1600, [1.0, 0.0])] * 3 + [(100, [1.0, 1.0])]
    df = llm.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest(df).collect()
    part = {i for i, _ in rows[:18]} | {1600}
    assert {r.query_id for r in got} == {i for i in part if i % 100 == 0} and {r.vec_id for r in got} <= part
    assert all(r.vec_id != r.query_id for r in got)
    for q in {r.query_id for r in got}:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine) and len(mine) == min(10, len(part) - 1)
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = llm.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 7, math.sqrt(2))]


def test_isolated_vectors_among_clusters_find_their_neighbours_too(llm):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([centres[rng.integers(0, 40, 3980)] + 0.01 * rng.standard_normal((3980, 64)), 6 * rng.standard_normal((20, 64))])
    ids = np.concatenate([np.arange(3980) * 10 + 7, np.arange(20) * 100])
    ids[rng.choice(3980, 30, False)] = 50_000 + 100 * np.arange(30)
    df = llm.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).collect()
    hits = 0
    queries = ids[ids % 100 == 0]
    for q in queries:
        d = ((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1)
        want = [i for _, i in sorted((v, i) for v, i in zip(d, ids) if i != q)][:10]
        mine = [r.vec_id for r in got if r.query_id == q]
        assert len(mine) == 10
        hits += len(set(want) & set(mine))
    assert hits >= 0.9 * 10 * len(queries)


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 32))
    r = neighbours.Rotation(x)
    r.radius = 9
    codes = r.codes(x)
    got = neighbours.search_block(r, np.arange(20), x[:20], np.arange(600), x, 600)
    want = {(q, i) for q in range(20) for i in range(600) if i != q and sum(bin(a ^ b).count("1") for a, b in zip(codes[q].tolist(), codes[i].tolist())) <= 9}
    assert {(q, i) for q, i, _ in got} == want and want


def test_quality_held_out_accuracy(llm):
    out = QUERIES["op8_quality_classifier"](llm, SF01)
    assert out.count() == 1000
    rows = out.join(llm.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    good = [r for r in rows if r.quality == 1]
    assert right > 0.93 and sum(r.predicted for r in good) / len(good) > 0.97
    pos, neg = [r.score for r in good], [r.score for r in rows if r.quality == 0]
    assert sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.95


def test_quality_edge_cases(llm):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdef") * rng.randint(1, 6) for _ in range(30)) if i % 2 else "spam spam spam " * 20) for i in range(400)]
    rows += [(None, "text"), (500, None), (501, ""), (502, "q" * 200000), (3, "again"), (503, "😀 \n\t")]
    docs = llm.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    labels = llm.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(5, None, 0), (None, 1, 0), (7, 9, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    stats, model = quality.train(docs, labels)
    out = quality.score_statistics(stats, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    good = {r.doc_id for r in out if r.score >= 0.3}
    assert len({i for i in good if i and i < 400 and i % 2}) > 190 and len({i for i in good if i and i < 400 and not i % 2}) < 10
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in out)
    _, none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score_statistics(stats, none).collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_pool_is_isotonic_least_squares():
    rng = np.random.default_rng(2)
    for _ in range(20):
        y, w = rng.random(12), rng.integers(1, 5, 12).astype(float)
        levels, block = quality.pool(y, w)
        assert np.all(np.diff(levels) > 0)
        for b in range(len(levels)):
            assert abs(np.average(y[block == b], weights=w[block == b]) - levels[b]) < 1e-12
