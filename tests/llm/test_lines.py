import random

import numpy as np

from ulasan.llm import line_dedup as ld

from .test_dedup import brute_components


def brute(rows):
    """Exact single-linkage components over all distinct lines."""
    order = sorted({(i if i is not None else ld.LAST, t or "") for i, t, *_ in rows}, key=lambda r: r[0])
    places, norm = [], []
    for i, t in order:
        for k, line in enumerate(ld.normalized(t)):
            if line:
                places.append((i, t, k))
                norm.append(line)
    distinct = sorted(set(norm))
    sets = [ld.shingles(x) for x in distinct]
    at = {x: k for k, x in enumerate(distinct)}
    links = [(a, b) for a in range(len(distinct)) for b in range(a) if ld.jaccard(sets[a], sets[b]) >= 0.8]
    root = brute_components(range(len(distinct)), links)
    seen, gone = set(), set()
    for place, line in zip(places, norm):
        r = root[at[line]]
        gone |= {place} if r in seen else set()
        seen.add(r)
    def kept(i, t):
        if t is None:
            return None
        i = ld.LAST if i is None else i
        return "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)
    return sorted((str(i), str(kept(i, t))) for i, t, *_ in rows)


def make_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    bases = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(60)]
    def line():
        b = rng.choice(bases)
        k = rng.random()
        if k < 0.4:
            return b
        if k < 0.7:
            i = rng.randrange(len(b))
            return b[:i] + rng.choice("xyz") + b[i + 1:]
        if k < 0.8:
            return "  " + b.upper() + " "
        return " ".join(word() for _ in range(10)) if k < 0.95 else rng.choice(["", "é", "ab", "😀 ok", "\t"])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 8))), None, 5) for i in range(80)]
    rows += [(200, None, "x", None), (201, "", "x", 0), (None, bases[0] + "\nonly here, once", "x", 1), (202, "\n".join([bases[1]] * 3000), "x", 9)]
    return rows + [rows[3], rows[4]]


def test_lines_equal_brute_force(llm, monkeypatch):
    rows = make_rows()
    df = llm.createDataFrame(rows, "doc_id long, text string, n_lines string, n_chars long").repartition(5)
    out = ld.dedup_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == want
    changed = [r for r in got if r.doc_id == 202][0]
    assert changed.n_chars == len(changed.text)
    counted = ld.dedup_lines(df, counts=True).collect()
    assert {r.n_lines for r in counted if r.doc_id == 202} == {3000} and sum(r.n_removed for r in counted) > 100
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_large_buckets_are_compared_in_chunks(llm, monkeypatch):
    monkeypatch.setattr(ld, "CHUNK", 7)
    monkeypatch.setattr(ld, "BROADCAST_KEYS", 0)
    base = "the quick brown fox jumps over the lazy dog and then runs far away from the old house again and again"
    rows = [(i, base[:40 + i] + "%02d" % i + base[40 + i:], "", 0) for i in range(50)] + [(90, "quite another line of text, unlike all", "", 0)]
    df = llm.createDataFrame(rows, "doc_id long, text string, n_lines string, n_chars long")
    assert sorted((str(r.doc_id), str(r.text)) for r in ld.dedup_lines(df).collect()) == brute(rows)


def test_one_edit_in_an_ordinary_line_links(llm):
    """By hand, without ``shingles``: sets of five characters, similarity 0.8."""
    def five(a, b):
        x, y = ({line[i:i + 5] for i in range(len(line) - 4)} for line in (a, b))
        return len(x & y) / len(x | y)

    short = "please send the signed form back to our office in may 2021"            # 58 characters
    long = "the quick brown fox jumps over a lazy dog while seven other small animals watch it from the old barn"
    far = "we sold four red bikes, two kites and a drum set last week"
    pairs = [(short, short.replace("office", "offise")), (long, long.replace("seven", "forty")), (far, far.replace("kites and a drum", "boats or one lamp"))]
    assert 49 <= len(short) < 79 and len(long) <= 100
    assert [five(a, b) >= 0.8 for a, b in pairs] == [True, True, False]
    rows = [(2 * k + j, p[j], "", 0) for k, p in enumerate(pairs) for j in (0, 1)]
    df = llm.createDataFrame(rows, "doc_id long, text string, n_lines string, n_chars long")
    got = {r.doc_id: r.text for r in ld.dedup_lines(df).collect()}
    assert got == {0: short, 1: "", 2: long, 3: "", 4: pairs[2][0], 5: pairs[2][1]}


def test_bands_find_pairs_at_the_threshold():
    assert 1 - (1 - ld.NEAR ** ld.ROWS) ** ld.BANDS > 0.9949
    rng = random.Random(8)
    found = 0
    for _ in range(300):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(95))
        i = rng.randrange(10, 80)
        other = line[:i] + "#%&@?" + line[i + 5:]           # 9 of 91 shingles: 0.82
        found += bool((ld.signatures([line])[0] == ld.signatures([other])[0]).any())
    assert found >= 295


def test_pairs_of_many_buckets_are_compared_at_once():
    """Exactly as by sets, also in larger buckets and where alphabets are wide."""
    rng = random.Random(6)
    wide = [chr(c) for c in range(0x4e00, 0x4e00 + 6000)]
    for _ in range(150):
        lines = ["".join(rng.choice(a) for _ in range(rng.randint(rng.choice([1, 5]), 60)))
                 for a in (rng.choice(["abc", "ab\0😀é", wide, wide[:700]]) for _ in range(rng.randint(1, 40)))]
        lines += [x[:-1] + "z" for x in lines] + [x + "q" for x in lines]
        buckets = []
        for _ in range(12):
            nodes = rng.sample(range(len(lines)), min(len(lines), rng.randint(1, 25)))
            buckets.append((nodes, [lines[i] for i in nodes], rng.choice([None, [rng.random() < 0.5 for _ in nodes]])))
        assert sorted(ld.buckets_links(buckets)) == sorted(x for b in buckets for x in ld.bucket_links(*b))
    assert ld.buckets_links([]) == []


def test_lines_without_white_space_to_collapse_are_left_alone():
    rng = random.Random(2)
    signs = ["a", "B", " ", "\n", "\t", " ", "\x1c", "\x85", "Σ", "σ", ".", "İ", " ", "　", "​", "́", "é", "\r", "\x0b"]
    for _ in range(20000):
        text = "".join(rng.choice(signs[:rng.choice([4, 4, 8, 19])]) for _ in range(rng.randint(0, 12)))
        assert ld.normalized(text) == [" ".join(x.lower().split()) for x in text.split("\n")]


def test_bands_are_dealt_packed_and_shared_ones_found(llm, monkeypatch):
    """One row a slot and task, not one a band hash; buckets as by a dictionary."""
    monkeypatch.setattr(ld, "CHUNK", 5)
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdefghij ") for _ in range(80)) for _ in range(30)]
    texts = ["\n".join(b[:k] + "#" + b[k + 1:] for b in rng.sample(bases, 6) for k in [rng.randrange(10, 70)]) for _ in range(60)]
    keyed = ld._keyed(llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3))
    dealt = ld._bands(keyed, 64).collect()
    (k1, _), lines = ld._distinct(set(), texts)
    assert len(dealt) <= 3 * 64 < len(lines) * ld.BANDS
    want = {(int(b), int(k)) for k, row in zip(k1, ld.signatures(lines).astype(np.uint64).view(np.int64).tolist()) for b in row}
    pairs = [(r.slot, *p) for r in dealt for p in np.frombuffer(r.pairs, dtype=np.int64).reshape(-1, 2).tolist()]
    assert {(b, k) for _, b, k in pairs} == want and all((b % (1 << 64)) >> 58 == slot for slot, b, _ in pairs)
    held = {}
    for b, k in want:
        held.setdefault(b, set()).add(k)
    shared = {b: sorted(ks) for b, ks in held.items() if len(ks) > 1}
    got = {}
    for r in sorted(ld._buckets(keyed, 64).collect(), key=lambda r: (r.band, r.c)):
        assert r.n == -(-len(shared[r.band]) // 5) and 0 < len(r.lines) <= 5
        got.setdefault(r.band, []).extend(r.lines)
    assert got == shared and max(map(len, got.values())) > 5


def test_shared_bands_of_odd_pairs():
    empty = np.zeros((0, 2), dtype=np.int64)
    assert [len(x) for x in ld.shared_bands(empty)] == [0, 0, 0]
    assert [len(x) for x in ld.shared_bands(np.array([[7, 1], [7, 1], [8, 1]]))] == [0, 0, 0]     # one line twice shares nothing
    band, starts, lines = ld.shared_bands(np.array([[7, 3], [9, 5], [7, -1], [7, 3], [-2, 4], [9, 2]]))
    assert (band.tolist(), starts.tolist(), lines.tolist()) == ([7, 9], [0, 2], [-1, 3, 2, 5])


def test_slots_grow_with_the_pairs():
    assert ld.slots(0, 8) == 64
    assert all(p / ld.slots(p, n) <= ld.SLOT for p in (10 ** 6, 10 ** 8, 10 ** 10) for n in (1, 200))
    assert 16 * 51 <= ld.slots(41_000_000, 51) <= 32 * 51
