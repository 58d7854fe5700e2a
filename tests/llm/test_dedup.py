import random

from xxhash import xxh64_intdigest

from ulasan.llm import simhash
from ulasan.llm.components import components


def brute_fingerprint(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
            {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_components_chain_star_and_random(llm):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(200)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(250)]
    links += [(5, 5), (None, 7), (3, 2), (3, 2)]
    df = llm.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    clean = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = brute_components({x for p in clean for x in p}, clean)
    assert got == want
    assert components(df.limit(0)).count() == 0


def test_golay_keys_meet_within_two_bits():
    import numpy as np
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(23)
        y = x ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23))
        a, b = simhash.golay_keys(np.array([x, y], dtype=np.int64))
        assert set(a[a >= 0].tolist()) & set(b[b >= 0].tolist())
        assert (a >= 0).sum() in (1, 6)


def test_links_equal_brute_force(llm):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for c in centres for _ in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    rows = [(f, i) for i, f in enumerate(signed)]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(llm.createDataFrame(rows, "fp long, rep long")).collect()}
    want = {(i, j) for f, i in rows for g, j in rows if i < j and bin((f ^ g) & (1 << 64) - 1).count("1") <= 2}
    assert got == want and len(want) > 50


def test_simhash_groups_brute_force(llm):
    rng = random.Random(6)
    words = ["Ab", "cd", "EF", "gh", "ÄÖ", "ij k", "lm"]
    texts = [None, "", " \t\n", "one", "one two", "ONE  two", "a b c", "a\x0bb\x1cc"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        texts += [" ".join(base), "\t".join(base).lower(), " ".join(base[:-1])]
    texts += ["long " * 50000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "one", "x"), (None, "one", "x"), (None, "only here", "x")]
    out = simhash.simhash_groups(llm.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(out) == len(rows)
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in fp for j in fp if i < j and bin(fp[i] ^ fp[j]).count("1") <= 2]
    root = brute_components(fp, links)
    for r in out:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == fp[r.doc_id] and r.component_id == root[r.doc_id]
    nulls = sorted((r.component_id is None, r.component_id) for r in out if r.doc_id is None)
    assert nulls == [(False, root[3]), (True, None)]
    assert simhash.simhash_groups(llm.createDataFrame([], "doc_id long, text string")).count() == 0
