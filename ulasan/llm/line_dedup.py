"""Line dedup (operator 2): near-equal lines by MinHash, one line of each
component stays.

A line is compared in lower case with white space collapsed; blank lines are
left alone. Two lines link if the Jaccard similarity of their sets of five
character shingles is ``NEAR`` = 0.8 or more (a shorter line is one shingle).
Such shingles are common, so a band has six minima: with fewer, ever more
unrelated lines of one language share a band as the corpus grows.

1. Equal lines: every occurrence has a 128-bit hash of its line; the first
   occurrence of each hash is aggregated (map side first).
2. Signatures: ``BANDS`` bands of ``ROWS`` minima for each distinct line of a
   task; at similarity 0.8 a pair shares a band with probability 0.996, at 0.9
   with more than 0.9999. Only hashes are shuffled: a task deals them to slots by
   their first bits, packed, and each slot is sorted in one go. The slots grow in
   number with the lines, so that one holds about ``SLOT`` pairs at any size
   (more only if very many different lines share one band).
3. Verification: only lines that share a band with another one get their text
   again. Inside a bucket, lines are compared exactly: shingles as numbers, many
   small buckets in one sort, a larger one by a matrix product. A bucket returns
   at most one link a line. Buckets above ``CHUNK`` lines are split into chunks,
   and every pair of chunks is compared in a task of its own: no comparison is
   dropped and no task holds more than two chunks.
4. Union-find over the links (``components``), and the first line of every
   component, by (doc_id, line number), stays.
5. The documents are joined with the numbers of their dropped lines.

Edge cases: NULL texts stay NULL. Documents are told apart by doc_id and text,
so repeated rows are treated as one document and changed alike. Rows without a
doc_id come last in the order. A document whose lines all go keeps an empty
text. Only ``text``, and ``n_chars`` of changed rows, change; other columns pass
through.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import shuffle_partitions, whole_text
from .components import components

NEAR = 0.8
SHINGLE = 5
ROWS, BANDS = 6, 18
CHUNK = 1024
#: Distinct lines with a shared band up to which their hashes are broadcast (8 bytes each).
BROADCAST_KEYS = 500_000
#: Pairs of a band hash and a line (16 bytes each) that a task gathers before it deals them by slot, and those meant for a slot.
PAIRS, SLOT = 1 << 18, 1 << 19
#: Lines a task remembers to skip repeated ones.
SEEN = 300_000
#: Code points of a block of lines whose signatures are made together, and of one whose pairs are compared together.
BLOCK, PAIR_BLOCK = 1 << 17, 1 << 16
#: White space besides spaces and line feeds.
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Lines of a bucket up to which all its pairs are compared with those of other buckets in one sort.
SMALL = 8
#: Shingles in a part of the matrix that counts the common ones of a larger bucket.
COLUMNS = 2048
LAST = (1 << 63) - 1


def normalized(text: str) -> list[str]:
    text = text.lower()
    lines = text.split("\n")
    blank = np.frombuffer(f"\n{text}\n".encode("utf-8", "surrogatepass"), dtype=np.uint8) <= 32
    if (blank[1:] & blank[:-1]).any() or any(x in text for x in BLANKS):
        return [" ".join(line.split()) for line in lines]
    return lines                                            # no white space to collapse


def shingles(line: str) -> frozenset:
    return frozenset(line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    if min(len(a), len(b)) < NEAR * max(len(a), len(b)):
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _hashes(digests: list[bytes]) -> np.ndarray:
    """The two halves of each 128-bit digest, as columns of signed numbers."""
    halves = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(halves.view(np.int64).T)


def signatures(lines: list[str], seed: int = 11) -> np.ndarray:
    """``BANDS`` band hashes of each line (code points in UTF-32), made for
    blocks of lines whose arrays stay small."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
    ends = np.cumsum([len(x) for x in lines])
    cuts = np.flatnonzero(np.diff(ends // BLOCK)) + 1
    return np.concatenate([_signatures(lines[i:j], mult, plus) for i, j in zip([0, *cuts], [*cuts, len(lines)])])


def _signatures(lines: list[str], mult: np.ndarray, plus: np.ndarray) -> np.ndarray:
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in padded])
    first = np.cumsum(size) - size
    n = len(points) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + points[j:j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)).astype(np.uint32)
    inside = np.ones(n, dtype=bool)                       # shingles that stay in their line
    for j in range(1, SHINGLE):
        inside[(first[1:] - j)] = False
    h = h[inside]
    count = size - SHINGLE + 1
    at = np.cumsum(count) - count
    least = np.empty((ROWS * BANDS, len(lines)), dtype=np.uint32)
    x = np.empty_like(h)
    for p in range(ROWS * BANDS):
        np.multiply(h, mult[p], out=x)
        x += plus[p]
        np.minimum.reduceat(x, at, out=least[p])
    bands = np.zeros((BANDS, len(lines)), dtype=np.uint64)
    for r in range(ROWS):
        bands ^= least[r::ROWS]
        bands *= np.uint64(0x9E3779B97F4A7C15)
        bands ^= bands >> np.uint64(31)
    return bands.T ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(58))


def _distinct(seen: set, texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Hashes and texts of lines that the task has not met (it forgets at
    ``SEEN``, which only repeats work)."""
    from xxhash import xxh3_128_digest

    keys, out = [], []
    for t in texts:
        for line in normalized(t):
            if line:
                key = xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    out.append(line)
        if len(seen) > SEEN:
            seen.clear()
    return _hashes(keys), out


def occurrences(keyed: DataFrame) -> DataFrame:
    """``(o, th, line_no, k1, k2)`` of every line that is not blank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            count, no, keys = [], [], []
            for t in batch.column(2).to_pylist():
                lines = normalized(t)
                at = [i for i, line in enumerate(lines) if line]
                count.append(len(at))
                no += at
                keys += [xxh3_128_digest(lines[i].encode("utf-8", "surrogatepass")) for i in at]
            take = pa.array(np.repeat(np.arange(len(count), dtype=np.int32), count))
            k1, k2 = _hashes(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(no, pa.int32()),
                                              pa.array(k1), pa.array(k2)], names=["o", "th", "line_no", "k1", "k2"])

    return keyed.mapInArrow(run, "o long, th long, line_no int, k1 long, k2 long")


def slots(pairs: int, partitions: int) -> int:
    """A power of two, 65,536 at most: about ``SLOT`` pairs or fewer in a slot,
    and, if the pairs are many, several slots in a partition, which evens the
    partitions out."""
    return 1 << min(16, max(6, (pairs // SLOT).bit_length(), min((16 * partitions).bit_length(), (pairs // 4096).bit_length())))


def _bands(keyed: DataFrame, slots: int) -> DataFrame:
    """``(slot, pairs)``: the band hashes of a task's lines and the first halves
    of the lines' hashes, dealt by the hashes' first bits; one row a slot for
    ``PAIRS`` of them or more."""
    most = max(PAIRS, 64 * slots)                           # rows of 64 pairs and more, however many slots
    shift = np.uint64(65 - slots.bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list = []

        def rows() -> pa.RecordBatch:
            band, k1 = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            slot = (band >> shift).astype(np.uint16)
            order = np.argsort(slot, kind="stable")
            slot, pairs = slot[order], np.stack([band.view(np.int64)[order], k1[order]], axis=1)
            cuts = np.flatnonzero(np.diff(slot)) + 1
            return pa.RecordBatch.from_arrays([pa.array(slot[[0, *cuts]], pa.int32()), pa.array([x.tobytes() for x in np.split(pairs, cuts)], pa.binary())],
                                              names=["slot", "pairs"])

        for batch in batches:
            (k1, _), lines = _distinct(seen, batch.column(0).to_pylist())
            if lines:
                held.append((signatures(lines).ravel(), np.repeat(k1, BANDS)))
            if sum(len(x) for x, _ in held) > most:
                yield rows()
        if held:
            yield rows()

    return keyed.select("text").mapInArrow(run, "slot int, pairs binary")


def shared_bands(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The band hashes that different lines of ``pairs`` (band, k1) have, where
    the lines of each begin, and the lines, sorted within a band."""
    band, k1 = pairs.T
    order = np.argsort(band)
    band = band[order]
    same = np.zeros(len(band) + 1, dtype=bool)
    same[1:-1] = band[1:] == band[:-1]
    several = same[1:] | same[:-1]
    band, k1 = band[several], k1[order[several]]
    order = np.lexsort((k1, band))
    band, k1 = band[order], k1[order]
    new = np.concatenate([[True], (band[1:] != band[:-1]) | (k1[1:] != k1[:-1])])[:len(band)]
    band, k1 = band[new], k1[new]
    starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])[:len(band)])
    size = np.diff(np.append(starts, len(band)))
    keep = np.repeat(size > 1, size)
    size = size[size > 1]
    starts = np.cumsum(size) - size
    return band[keep][starts], starts, k1[keep]


def _buckets(keyed: DataFrame, slots: int) -> DataFrame:
    """``(band, n, c, lines)``: the lines that share a band hash, by ``k1``; more
    than ``CHUNK`` of them in ``n`` chunks, ``c`` from 0. A task holds the pairs
    of one slot."""
    chunk = CHUNK

    def found(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        band, starts, k1 = shared_bands(np.frombuffer(b"".join(parts), dtype=np.int64).reshape(-1, 2))
        size = np.diff(np.append(starts, len(k1)))
        n = -(-size // chunk)
        c = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        offsets = np.append(np.repeat(starts, n) + c * chunk, len(k1)).astype(np.int32)
        rows = pa.RecordBatch.from_arrays([pa.array(np.repeat(band, n)), pa.array(np.repeat(n, n), pa.int32()), pa.array(c, pa.int32()),
                                           pa.ListArray.from_arrays(pa.array(offsets), pa.array(k1))], names=["band", "n", "c", "lines"])
        if len(rows):
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for slot, pairs in zip(*[col.to_pylist() for col in batch.columns]):
                if slot != at:
                    if parts:
                        yield from found(parts)
                    at, parts = slot, []
                parts.append(pairs)
        if parts:
            yield from found(parts)

    dealt = _bands(keyed, slots).repartition(shuffle_partitions(keyed.sparkSession), "slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(run, "band long, n int, c int, lines array<long>")


def _lines(keyed: DataFrame, only=None) -> DataFrame:
    """``(k1, k2, line)`` of a task's lines; with ``only`` (a broadcast sorted
    array) of those whose ``k1`` it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            (k1, k2), lines = _distinct(seen, batch.column(0).to_pylist())
            if only is not None:
                known = only.value
                at = np.searchsorted(known, k1)
                at[at == len(known)] = 0
                has = np.flatnonzero(known[at] == k1) if len(known) else at[:0]
                k1, k2, lines = k1[has], k2[has], [lines[i] for i in has.tolist()]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(lines, pa.string())], names=["k1", "k2", "line"])

    return keyed.select("text").mapInArrow(run, "k1 long, k2 long, line string")


def _codes(lines: list[str]) -> tuple[np.ndarray, int]:
    """The shingles of ``lines`` (none shorter than a shingle), one behind the
    other, as numbers of so many bits: characters are numbered, so equal numbers
    are equal shingles. With an alphabet too wide for 64 bits, no numbers."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known = np.zeros(int(points.max()) + 1, dtype=bool)
    known[points] = True
    number = np.cumsum(known, dtype=np.uint64) - np.uint64(1)
    width = int(number[-1]).bit_length()
    if SHINGLE * width > 64:
        return np.zeros(0, dtype=np.uint64), SHINGLE * width
    rank = number[points]
    n = len(rank) - SHINGLE + 1
    code = rank[:n].copy()
    for j in range(1, SHINGLE):
        code <<= np.uint64(width)
        code |= rank[j:j + n]
    inside = np.ones(n, dtype=bool)                         # shingles that stay in their line
    borders = np.cumsum([len(x) for x in lines])[:-1]
    for j in range(1, SHINGLE):
        inside[borders - j] = False
    return code[inside], SHINGLE * width


def _sorted_set(key: np.ndarray) -> np.ndarray:
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])]


def _near(common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``jaccard`` >= ``NEAR`` for sets of ``count`` shingles, of which ``common`` are shared."""
    a, b = count[..., :, None], count[..., None, :]
    return (np.minimum(a, b) >= NEAR * np.maximum(a, b)) & (common / np.maximum(a + b - common, 1) >= NEAR)


def near_small(buckets: list[list[str]]) -> list[list[tuple[int, int]] | None]:
    """For each bucket of up to ``SMALL`` lines, the near pairs ``(j, i)`` of a
    line i and a later line j; None where lines must be compared as sets. One
    sort by bucket, shingle and line brings equal shingles together."""
    code, bits = _codes([x for lines in buckets for x in lines])
    low = (SMALL - 1).bit_length()
    if bits + low + len(buckets).bit_length() > 64:
        if len(buckets) == 1:
            return [None]
        half = len(buckets) // 2
        return near_small(buckets[:half]) + near_small(buckets[half:])
    head = [b << bits + low | i for b, lines in enumerate(buckets) for i in range(len(lines))]
    size = [len(x) - SHINGLE + 1 for lines in buckets for x in lines]
    key = _sorted_set(code << np.uint64(low) | np.repeat(np.array(head, dtype=np.uint64), size))
    line, bucket = (key & np.uint64((1 << low) - 1)).astype(np.int64), (key >> np.uint64(bits + low)).astype(np.int64)
    count = np.bincount(bucket * SMALL + line, minlength=len(buckets) * SMALL).reshape(-1, SMALL)
    common = np.zeros(len(buckets) * SMALL * SMALL, dtype=np.int64)
    shingle = key >> np.uint64(low)
    at = np.flatnonzero(shingle[1:] == shingle[:-1])
    for d in range(1, max(map(len, buckets))):
        if d > 1:
            at = at[:np.searchsorted(at, len(key) - d)]
            at = at[shingle[at] == shingle[at + d]]
        common += np.bincount((bucket[at] * SMALL + line[at + d]) * SMALL + line[at], minlength=len(common))
    out: list = [[] for _ in buckets]
    for b, j, i in zip(*[x.tolist() for x in np.nonzero(_near(common.reshape(-1, SMALL, SMALL), count))]):
        if i < j:
            out[b].append((j, i))
    return out


def near_large(lines: list[str]) -> list[tuple[int, int]] | None:
    """The same for one bucket of many lines: a matrix of lines and the shingles
    that at least two of them have, some columns at a time, times its transpose."""
    code, bits = _codes(lines)
    low = len(lines).bit_length()
    if bits + low > 64:
        return None
    key = _sorted_set(code << np.uint64(low) | np.repeat(np.arange(len(lines), dtype=np.uint64), [len(x) - SHINGLE + 1 for x in lines]))
    line, shingle = (key & np.uint64((1 << low) - 1)).astype(np.int64), key >> np.uint64(low)
    count = np.bincount(line, minlength=len(lines))
    column = np.concatenate([[0], np.cumsum(shingle[1:] != shingle[:-1])])
    shared = np.bincount(column)[column] > 1
    line, column = line[shared], column[shared]
    column = np.cumsum(np.diff(column, prepend=column[:1]) > 0)
    common = np.zeros((len(lines), len(lines)), dtype=np.float32)    # whole numbers, exact below 2 ** 24
    for k in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        part = slice(*np.searchsorted(column, [k, k + COLUMNS]))
        has = np.zeros((len(lines), min(COLUMNS, int(column[-1]) + 1 - k)), dtype=np.float32)
        has[line[part], column[part] - k] = 1
        common += has @ has.T
    return list(zip(*[x.tolist() for x in np.nonzero(np.tril(_near(common.astype(np.int64), count), -1))]))


def bucket_links(nodes: list[int], lines: list[str], right: list[bool] | None = None,
                 near: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Links that connect the components of the similarity graph. With
    ``right``, only pairs of a left and a right line need comparing. ``near``
    holds the near pairs; without it the lines' sets are compared here."""
    if near is None:
        sets = [shingles(x) for x in lines]
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in ((i, j) for i in range(len(nodes)) for j in range(i)) if near is None else near:
        if right is not None and right[i] == right[j]:
            continue
        a, b = find(i), find(j)
        if a != b and (near is not None or jaccard(sets[i], sets[j]) >= NEAR):
            root[max(a, b)] = min(a, b)
            out.append((nodes[i], nodes[j]))
    return out


def buckets_links(buckets: list[tuple[list[int], list[str], list[bool] | None]]) -> list[tuple[int, int]]:
    """``bucket_links`` of several ``(nodes, lines, right)``; those of up to
    ``SMALL`` lines are compared together."""
    out, small = [], []
    for nodes, lines, right in buckets:
        if len(nodes) < 2:
            continue
        if min(map(len, lines)) < SHINGLE:                  # a line that is one short shingle
            out += bucket_links(nodes, lines, right)
        elif len(nodes) > SMALL:
            out += bucket_links(nodes, lines, right, near_large(lines))
        else:
            small.append((nodes, lines, right))
    if small:
        for (nodes, lines, right), near in zip(small, near_small([x[1] for x in small])):
            out += bucket_links(nodes, lines, right, near)
    return out


def _verify(buckets: DataFrame) -> DataFrame:
    """Links within each ``bucket`` of ``(bucket, two, right, node, line)``; the
    rows of a bucket stand together in a partition and buckets are read one by
    one, some ``PAIR_BLOCK`` code points at a time. ``two``: only left and right
    lines need comparing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, lines, sides = None, [], [], []
        held, points = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            links = buckets_links(held)
            held.clear()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for bucket, two, right, node, line in zip(*[col.to_pylist() for col in batch.columns]):
                if (bucket, two) != key:
                    held.append((nodes, lines, sides if key and key[1] else None))
                    if points > PAIR_BLOCK:
                        yield from rows()
                        points = 0
                    key, nodes, lines, sides = (bucket, two), [], [], []
                nodes.append(node)
                lines.append(line)
                sides.append(right)
                points += len(line)
        held.append((nodes, lines, sides if key and key[1] else None))
        yield from rows()

    together = buckets.repartition(shuffle_partitions(buckets.sparkSession), "bucket", "two").sortWithinPartitions("bucket", "two", "node")
    return together.select("bucket", "two", "right", "node", "line").mapInArrow(run, "a long, b long")


def near_lines(keyed: DataFrame, n_lines: int) -> DataFrame:
    """``(k1, k2, root)`` of every line that has a near-equal other line.
    ``n_lines`` is the number of lines of ``keyed``."""
    spark = keyed.sparkSession
    buckets = materialize(_buckets(keyed, slots(n_lines * BANDS, shuffle_partitions(spark))), "lines-band")
    keys = materialize(buckets.select(F.explode("lines").alias("k1")).distinct(), "lines-keys")
    if keys.count() <= BROADCAST_KEYS:
        found = _lines(keyed, spark.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy())))
    else:
        found = _lines(keyed).join(keys, "k1")
    lines = materialize(found.dropDuplicates(["k1", "k2"]).withColumn("node", F.monotonically_increasing_id()), "lines-text")
    c, other = F.col("c"), F.col("x")
    # every two chunks of a large bucket, and each chunk with itself, are a set of their own
    large = (buckets.where("n > 1").repartition("band", "c").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .groupBy("band", F.least(c, other).alias("ci"), F.greatest(c, other).alias("cj"))
             .agg(F.sort_array(F.collect_list(F.struct("c", "lines"))).alias("both"))
             .select(F.col("both")[0]["lines"].alias("one"), F.when(F.size("both") > 1, F.element_at("both", 2)["lines"]).alias("two")))
    # many bands give the same bucket: each set of lines (two chunks at most) is compared once
    sets = buckets.where("n = 1").select(F.col("lines").alias("one"), F.lit(None).cast("array<long>").alias("two")).unionByName(large).distinct()
    rows = sets.select(F.xxhash64("one", "two").alias("bucket"), F.col("two").isNotNull().alias("two"), F.size("one").alias("left"),
                       F.posexplode(F.concat("one", F.coalesce("two", F.array().cast("array<long>")))).alias("at", "k1"))
    members = rows.join(lines.select("k1", "node", "line"), "k1").withColumn("right", F.col("at") >= F.col("left"))
    roots = components(_verify(members))
    return materialize(lines.join(roots, "node").select("k1", "k2", "root"), "lines-near")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(o, th, lines)``: the numbers of the lines that go, by document."""
    keyed = _keyed(docs)
    places = materialize(occurrences(keyed), "lines")
    place = F.struct("o", "th", "line_no")
    near = near_lines(keyed, places.count())
    first = places.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.join(near, ["k1", "k2"], "left").where("n > 1 OR root IS NOT NULL").select("k1", "k2", "first", "root"), "lines-first")
    one = first.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("root_first"))
    keep = first.join(one, "root", "left").select("k1", "k2", F.coalesce("root_first", "first").alias("keep"))
    gone = places.join(keep, ["k1", "k2"]).where(place != F.col("keep"))
    return gone.groupBy("o", "th").agg(F.collect_set("line_no").alias("lines"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("o"), F.xxhash64(text).alias("th"), text.alias("text"))


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one. ``counts`` adds
    ``n_lines`` (of the input) and ``n_removed``."""
    gone = dropped_lines(docs).select(F.col("o").alias("__o"), F.col("th").alias("__th"), F.col("lines").alias("__gone"))
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == F.col("__o")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__th"))
    joined = docs.join(gone, key, "left").select(*[docs[c] for c in docs.columns], "__gone")
    fields = [f for f in docs.schema.fields if not (counts and f.name in ("n_lines", "n_removed"))]
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())] if counts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, gone = batch.column(names.index("text")).to_pylist(), batch.column(names.index("__gone")).to_pylist()
            kept, n_lines, removed = [], [], []
            for t, g in zip(texts, gone):
                lines = (t or "").split("\n")
                if g:
                    drop = set(g)
                    t = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                kept.append(t)
                n_lines.append(len(lines))
                removed.append(len(g or ()))
            cols = []
            for f in fields:
                col = batch.column(names.index(f.name))
                if f.name == "text":
                    col = pa.array(kept, col.type)
                elif f.name == "n_chars":
                    col = pa.array([len(t) if g else v for t, g, v in zip(kept, gone, col.to_pylist())], col.type)
                cols.append(col)
            if counts:
                cols += [pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields] + [f.name for f in extra])

    return joined.mapInArrow(run, T.StructType(fields + extra))
