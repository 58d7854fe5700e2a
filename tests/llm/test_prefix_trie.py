import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest

from ulasan.llm import prefix_trie as T
from ulasan.llm.catalog import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos int, t string, k int, key int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, digest(role, text), (role, text)))
    convs = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h, first = crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(convs.get(first, [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[:d - 1]].add(v[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        if node:
            saved[node] += (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1]))
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids[v]), leaves[v], saved[v],
                    sha256(",".join(str(c) for c in sorted(m) if built[c] == v).encode()).hexdigest()) for v, m in members.items()), key=repr)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    say = lambda k: rng.choice(["yes", "no  no", None, "", "a\tb\nc é", f"only {k}"])
    rows = []
    for c in rng.sample(range(-45, 400), n):
        length = rng.choice([1, 2, 3, 3, 4, 5, 9, 30])
        for i in range(length):
            first = rng.random() < 0.7 and i < 4
            rows.append((c, i if rng.random() < 0.95 else None, "user" if i % 2 == 0 else rng.choice(["assistant", None]),
                         "hot start" if first else say(c * 100 + i), 1, 2, "clash", 3, 4))
    for c in range(1000, 1040):                             # copies
        rows += [(c, i, "user", f"same {i}", 1, 2, "clash", 3, 4) for i in range(11)]
    return rows + rows[:5] + [(None, 1, "user", "nobody's", 1, 2, "clash", 3, 4)]


def nodes(spark, rows, **kw):
    return sorted(map(tuple, T.prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw).select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("band,shard_turns", [(4, 20), (64, 200_000)])
def test_equals_brute_force(llm, band, shard_turns):
    rows = rows_of(band)
    assert nodes(llm, rows, band=band, shard_turns=shard_turns) == brute(rows)


def test_one_long_conversation_and_hot_prefix_dealt_by_segment(llm):
    rows = [(20, i, "u", f"turn {i % 7}", 1, 2, "c", 3, 4) for i in range(150)]
    rows += [(40 + c, i, "u", "hot" if i < 6 else f"own {c}", 1, 2, "c", 3, 4) for c in range(60) for i in range(8)]
    assert nodes(llm, rows, band=4, shard_turns=10) == brute(rows)


def test_empty_table(llm):
    assert nodes(llm, []) == []


def test_query_and_sql(llm, tmp_path):
    rows = rows_of(9, 60)
    llm.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    want = brute(rows)
    assert sorted(map(tuple, QUERIES["op13_prefix_trie"](llm, str(tmp_path)).select(COLUMNS).collect()), key=repr) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op13_prefix_trie']})").fetchall(), key=repr) == want


def test_ends_in_many_chunks(llm):
    rows = [(c, 0, "u", "x", 1, 2, "c", 3, 4) for c in [7, 65535, 65536, 200_000, 10 ** 12, -5, -70_000]]
    assert nodes(llm, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_double_array_holds_a_random_trie(seed):
    rng = np.random.default_rng(seed)
    trie, level, known = T.DoubleArray(), np.zeros(1, np.int64), {}
    for depth in range(3):
        pairs = sorted({(int(x), int(c)) for x in level for c in rng.choice(400, rng.choice([0, 1, 1, 2, 30]))})
        if not pairs:
            break
        a = np.array(pairs)
        trie.add_level(a[:, 0], a[:, 1])
        level = trie.step(a[:, 0], a[:, 1])
        assert (level > 0).all() and len(set(level.tolist())) == len(level)
        known.update(zip(pairs, level.tolist()))
    for (node, c), slot in known.items():
        assert trie.step(np.array([node]), np.array([c]))[0] == slot
    for node in {0, *known.values()}:
        found = trie.step(np.full(400, node), np.arange(400))
        assert {c for c in range(400) if found[c] >= 0} == {c for (x, c) in known if x == node}
