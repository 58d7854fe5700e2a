"""Prefix trie of conversations, by double arrays per shard (operator 13).

Each distinct sequence of first turns of some conversation is a node. Turns are
compared by a digest of role and text.

1. Turns get their place in their conversation (``ranks.py``), so one very long
   conversation is spread over many tasks. ``BAND`` consecutive turns make a
   segment. A segment's root is the digest of all turns before it; only
   conversations of several segments stream through a task for it, a row per
   segment.
2. Equal segments below equal roots are counted once, so copies of a
   conversation collapse before anything else.
3. Prefix shards: segments go to shards by their root and first turn. Where
   those hold more than ``SHARD_TURNS`` turns, the second turn counts as well, then
   the third, and what is still too large is dealt by the whole segment.
4. Each shard numbers its turns densely and packs a double array: the child of
   node s by turn c is slot ``BASE[s] + c``, and it is one if ``CHECK`` of that slot
   is s. The segments walk through the arrays, which adds up the nodes' members;
   the levels are folded upwards for leaves and saved tokens.
5. A node is closed when its whole subtree lies in its shard. The others, few but
   for very long conversations, are open: they stand above a shard's prefix, or
   on the way to a later segment. Their parts from all shards are merged by the
   digest of their prefix, and subtree sums among them are taken by pointer
   doubling, in rounds that grow with the logarithm of the depth.

Ids that end at a node are hashed in ascending order: sorted in chunks of 65,536
consecutive ids, which stream to one hash per node.

Edge cases: NULL role or text counts as empty; a NULL turn comes first; equal
turn numbers are ordered by digest; rows without a conv_id belong to no
conversation; a conversation that loses all its turns is a member of the root
alone; an empty table gives no nodes. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import shuffle_partitions
from .ranks import rank_in_key

#: Turns of a segment (4 at least: a conversation moves up by 3 turns at most).
BAND = 64
#: Turns of a shard, about.
SHARD_TURNS = 200_000
#: Conversations whose ids share a quotient by this get their heads from the first.
GROUP = 20

TURN = "struct<t:binary,w:int>"
OPEN_SCHEMA = ("open boolean, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, words long, "
               "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def turn_digest(role: str = "role", text: str = "text") -> Column:
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn)``: digest and words of every turn, placed from 0."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("number"), turn_digest().alias("t"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).alias("w"))
    return rank_in_key(rows, "conv_id", ["number", "t"]).select("conv_id", "pos", F.struct("t", "w").alias("turn"))


def _in_band(band: int, back: int):
    return lambda x: F.floor(x["pos"] / band) == F.col("k") - back


def rebuilt_segments(turns: DataFrame, band: int) -> DataFrame:
    """``(conv_id, k, turns, bands)``: the segments of every rebuilt conversation;
    one of no turns has one empty segment."""
    heads = (turns.where(f"pos < 3 AND conv_id % {GROUP} = 0").groupBy(F.col("conv_id").alias("first"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("h")).select("first", F.col("h.turn").alias("head")))
    known = F.when(F.col("head").isNull(), F.array().cast(f"array<{TURN}>")).otherwise(F.slice("head", F.lit(1), F.col("h").cast("int")))
    convs = materialize(
             turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "first": F.expr(f"conv_id - conv_id % {GROUP}")})
             .join(heads, "first", "left").select("conv_id", "n", "h", known.alias("head"))
             .withColumn("total", F.size("head") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))), "trie-conversations")
    own = (turns.groupBy("conv_id", F.expr(f"pos div {band}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("run"))
           .join(convs.select("conv_id", "h", F.size("head").alias("shift")), "conv_id")
           .withColumn("run", F.transform(F.filter("run", lambda x: x["pos"] >= F.col("h")),
                                          lambda x: F.struct((x["pos"] - F.col("h") + F.col("shift")).alias("pos"), x["turn"].alias("turn")))))
    # a conversation with fewer head turns than it lost moves up by some turns, so a run can reach into the segment before
    pieces = own.select("conv_id", F.explode(F.array(*[
        F.struct((F.col("k") - back).alias("k"), F.filter("run", _in_band(band, back)).alias("run")) for back in (0, 1)])).alias("p")).select("conv_id", "p.*").where("size(run) > 0")
    front = convs.select("conv_id", F.lit(0).cast("long").alias("k"),
                         F.transform("head", lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("turn"))).alias("run"))
    joined = pieces.unionByName(front).groupBy("conv_id", "k").agg(F.array_sort(F.flatten(F.collect_list("run"))).alias("run"))
    return (joined.join(convs.select("conv_id", F.expr(f"greatest(1, (total + {band - 1}) div {band})").alias("bands")), "conv_id")
            .select("conv_id", "k", F.col("run.turn").alias("turns"), "bands"))


def _rooted(segments: DataFrame) -> DataFrame:
    """Adds ``root``: the digest of all turns before the segment (empty for the
    first); ``seg`` is that of the turns up to its end."""
    digests = F.aggregate("turns", F.lit(b""), lambda a, x: F.concat(a, x["t"]))
    alone = segments.where("bands = 1").withColumn("root", F.lit(b""))
    several = segments.where("bands > 1").withColumn("joint", digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, root = None, b""
        for batch in batches:
            roots = []
            for c, joint in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if c != conv:
                    conv, root = c, b""
                roots.append(root)
                root = sha256(root + joint).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary())], names=["conv_id", "k", "root"])

    by = several.select("conv_id", "k", "joint").repartition(shuffle_partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "k")
    roots = by.mapInArrow(run, "conv_id long, k long, root binary")
    both = alone.unionByName(several.drop("joint").join(roots, ["conv_id", "k"]))
    return both.withColumn("seg", F.unhex(F.sha2(F.concat("root", digests), 256)))


def _ends(rooted: DataFrame) -> DataFrame:
    """``(root, seg, ends_sha256)`` of the segments that conversations end with."""
    chunks = (rooted.where("k = bands - 1").groupBy("root", "seg", F.shiftright("conv_id", 16).alias("chunk"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names = ["root", "seg", "ends_sha256"]
        types = [pa.binary(), pa.binary(), pa.string()]
        for batch in batches:
            done = []
            for root, seg, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (root, seg) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (root, seg), sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), types)], names=names)

    return (chunks.repartition(shuffle_partitions(rooted.sparkSession), "root", "seg").sortWithinPartitions("root", "seg", "chunk")
            .mapInArrow(run, "root binary, seg binary, ends_sha256 string"))


def distinct_segments(segments: DataFrame) -> DataFrame:
    """``(root, seg, k, turns, n_convs, conv_id, goes_on, ends_sha256)``: each
    distinct segment below each root, with its conversations counted."""
    rooted = materialize(_rooted(segments), "trie-segments")
    groups = rooted.groupBy("root", "seg").agg(
        F.first("k").alias("k"), F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max(F.col("k") < F.col("bands") - 1).alias("goes_on"))
    return groups.join(_ends(rooted), ["root", "seg"], "left")


def sharded(groups: DataFrame, shard_turns: int) -> DataFrame:
    """Adds ``bucket`` (the task that takes the segment) and ``level``: nodes of
    fewer turns below the root may be shared with other buckets."""
    prefix = [F.xxhash64("root", *[F.get(F.col("turns"), F.lit(i))["t"] for i in range(n)]) for n in (1, 2, 3)]
    rows = materialize(groups.withColumns({"p1": prefix[0], "p2": prefix[1], "p3": prefix[2]}), "trie-groups")
    by3 = rows.groupBy("p1", "p2", "p3").agg(F.sum(F.size("turns") + 1).alias("s3"))
    by2 = by3.groupBy("p1", "p2").agg(F.sum("s3").alias("s2"))
    by1 = by2.groupBy("p1").agg(F.sum("s2").alias("s1"))
    total = by1.agg(F.sum("s1")).first()[0] or 0
    buckets = max(1, -(-total // shard_turns))
    big1 = by1.where(F.col("s1") > shard_turns)
    big = (by3.join(big1, "p1").join(by2, ["p1", "p2"])
           .select("p1", "p2", "p3", F.when(F.col("s2") <= shard_turns, 2).when(F.col("s3") <= shard_turns, 3).otherwise(4).alias("big")))
    level = F.coalesce("big", F.lit(1))
    whole = F.xxhash64("seg")
    deal = F.when(level == 1, F.col("p1")).when(level == 2, F.col("p2")).when(level == 3, F.col("p3")).otherwise(whole)
    far = F.when(level == 4, F.lit(1 << 30)).otherwise(level)
    return (rows.join(big, ["p1", "p2", "p3"], "left")
            .withColumns({"bucket": F.pmod(F.xxhash64(deal), F.lit(buckets)), "level": far}).drop("p1", "p2", "p3", "big"))


class DoubleArray:
    """A trie over sequences of small integers, in two arrays."""

    #: Slots tried for a node of several children before a place behind all others.
    TRIES = 16

    def __init__(self):
        self.base = np.zeros(1, dtype=np.int64)
        self.check = np.zeros(1, dtype=np.int64)            # the top, slot 0, is its own parent
        self.end = 1                                        # all slots from here on are free
        self.window = 1                                     # where nodes of several children are tried

    def _room(self, slots: int) -> None:
        more = slots - len(self.check)
        if more > 0:
            more = max(more, len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, offsets: np.ndarray) -> int:
        """A slot for the first of several children such that all are free."""
        self._room(self.end + int(offsets[-1]) + 1)
        for p in (np.flatnonzero(self.check[self.window:self.end] < 0)[:self.TRIES] + self.window).tolist():
            self._room(p + int(offsets[-1]) + 1)
            if (self.check[p + offsets] < 0).all():
                return p
        self.window = self.end
        return self.end

    def add_level(self, nodes: np.ndarray, symbols: np.ndarray) -> None:
        """Gives ``nodes`` the children ``symbols`` (distinct pairs, sorted)."""
        first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        count = np.diff(np.r_[first, len(nodes)])
        for i, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            offsets = symbols[i:i + n] - symbols[i]
            p = self._place(offsets)
            self.base[nodes[i]] = p - symbols[i]
            self.check[p + offsets] = nodes[i]
            self.end = max(self.end, p + int(offsets[-1]) + 1)
        single = first[count == 1]                          # fits any free slot
        self._room(self.end + len(single))
        slots = np.flatnonzero(self.check < 0)[:len(single)]
        self.base[nodes[single]] = slots - symbols[single]
        self.check[slots] = nodes[single]
        self.end = max(self.end, int(slots[-1]) + 1 if len(slots) else 0)

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` by ``symbols``, -1 where there is none."""
        slots = self.base[nodes] + symbols
        there = (slots > 0) & (slots < len(self.check))
        there[there] = self.check[slots[there]] == nodes[there]
        return np.where(there, slots, -1)


def _shard_nodes(table: pa.Table, band: int) -> pa.Table:
    """The nodes of one shard: closed ones complete, open ones with what this
    shard adds to them."""
    n = table.num_rows
    turns = table.column("turns").combine_chunks()
    flat = turns.flatten()
    size = pc.list_value_length(turns).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.field("t").dictionary_encode()
    roots = table.column("root").combine_chunks().dictionary_encode()
    root_ids, n_roots = roots.indices.to_numpy(), len(roots.dictionary)
    ids = coded.indices.to_numpy().astype(np.int64) + n_roots       # codes: roots, then turns
    n_codes = n_roots + len(coded.dictionary)
    words = np.zeros(n_codes, dtype=np.int64)
    words[ids] = flat.field("w").to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    counted, least = table.column("n_convs").to_numpy(), table.column("conv_id").to_numpy()
    goes_on, level = table.column("goes_on").to_numpy(), table.column("level").to_numpy()
    seg, ends = table.column("seg").to_pylist(), table.column("ends_sha256").to_pylist()
    bands = table.column("k").to_numpy()

    # Codes are numbered densely in the order in which the levels meet them, so
    # that most children of a node have neighbouring numbers.
    trie, number, numbered = DoubleArray(), np.full(n_codes, -1, dtype=np.int64), 0
    at, live = np.zeros(n, dtype=np.int64), np.arange(n)
    path = []                                               # (rows, their nodes) of every depth
    for depth in range(int(size.max(initial=0)) + 1):
        live = live[size[live] >= depth]
        code = root_ids[live].astype(np.int64) if depth == 0 else ids[begin[live] + depth - 1]
        nodes, codes = np.divmod(np.unique(at[live] * n_codes + code), n_codes)
        new, met = np.unique(codes[number[codes] < 0], return_index=True)
        new = new[np.argsort(met)]
        number[new] = np.arange(numbered, numbered + len(new))
        numbered += len(new)
        order = np.lexsort((number[codes], nodes))
        trie.add_level(nodes[order], number[codes][order])
        at[live] = trie.step(at[live], number[code])
        path.append((live, at[live].copy()))

    m = len(trie.check)
    members, smallest = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max)
    deep, word, is_open = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
    example = np.zeros(m, np.int64)                         # a segment through the node
    for depth, (rows, nodes) in enumerate(path):
        np.add.at(members, nodes, counted[rows])
        np.minimum.at(smallest, nodes, least[rows])
        deep[nodes], example[nodes] = depth, rows
        is_open[nodes[(depth < level[rows]) | goes_on[rows]]] = True
        if depth:
            word[nodes] = words[ids[begin[rows] + depth - 1]]
    last = at                                               # where each segment ends
    used = np.flatnonzero(trie.check >= 0)[1:]              # all nodes but the top
    parent, ended = trie.check, np.full(m, -1, np.int64)
    ended[last] = np.arange(n)
    children, leaves, saved = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for depth in range(len(path) - 1, -1, -1):
        nodes = used[(deep[used] == depth) & ~is_open[used]]
        leaves[nodes] += children[nodes] == 0
        saved[nodes] += (members[nodes] - 1) * word[nodes]
        np.add.at(children, parent[nodes], 1)
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])

    # digests of open nodes, and of the open parents of closed ones
    raw, root_bytes = coded.dictionary, roots.dictionary
    keys: dict[int, bytes] = {}

    def key(node: int) -> bytes:
        if node not in keys:
            row, depth = int(example[node]), int(deep[node])
            root = root_bytes[int(root_ids[row])].as_py()
            if depth == 0:
                keys[node] = root
            elif int(last[row]) == node:
                keys[node] = seg[row]
            else:
                run = ids[begin[row]:begin[row] + depth] - n_roots
                keys[node] = sha256(root + b"".join(raw[int(i)].as_py() for i in run)).digest()
        return keys[node]

    shown = used[~(is_open[used] & (deep[used] == 0) & (bands[example[used]] > 0) & (children[used] == 0))]
    rows = {f: [] for f in ("open", "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "words", "n_children", "n_leaves",
                            "saved_tokens", "ends_sha256")}
    inner = (deep[shown] == 0) & (bands[example[shown]] > 0)        # the root of a later segment: its own row is in the segment before
    opened, top = is_open[shown], deep[shown] == 0
    up = parent[shown]
    open_up = ~top & is_open[up]
    rows["open"] = opened
    rows["key"] = [key(x) if o else None for x, o in zip(shown.tolist(), opened)]
    rows["parent"] = [key(x) if o else None for x, o in zip(up.tolist(), open_up)]
    none = lambda values, hide: pa.array(values, pa.int64(), mask=hide)
    rows["conv_id"] = none(smallest[shown], inner)
    rows["depth"] = deep[shown] + bands[example[shown]] * band
    rows["parent_conv_id"] = none(smallest[up], top | open_up)
    rows["n_convs"] = none(members[shown], inner)
    rows["words"] = none(word[shown], inner)
    rows["n_children"], rows["n_leaves"], rows["saved_tokens"] = children[shown], leaves[shown], saved[shown]
    rows["ends_sha256"] = [ends[i] if i >= 0 else None for i in ended[shown].tolist()]
    types = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]
    return pa.table({f: v if isinstance(v, pa.Array) else pa.array(v, t) for (f, v), t in zip(rows.items(), types)})


def _merged(nodes: DataFrame) -> DataFrame:
    """The open nodes, their parts merged and their subtrees summed."""
    parts = nodes.where("open").groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"),
        F.max("ends_sha256").alias("ends_sha256"))
    parts = materialize(parts, "trie-open")
    children = parts.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("c"))
    named = parts.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = materialize(
        parts.join(children, "key", "left").join(named, "parent", "left").withColumn("n_children", F.col("closed") + F.coalesce("c", F.lit(0)))
        .select("key", "parent", "depth", "n_convs", "conv_id", "parent_conv_id", "n_children", "ends_sha256",
                (F.col("l") + (F.col("n_children") == 0).cast("long")).alias("l"),
                (F.col("s") + (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("s")), "trie-open")
    sums = whole.select("key", F.col("parent").alias("up"), "l", "s")
    far, deepest = 1, whole.agg(F.max("depth")).first()[0] or 0
    while far <= deepest:           # sums cover descendants nearer than ``far``; ``up`` is the ancestor at that distance
        below = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("l").alias("bl"), F.sum("s").alias("bs"))
        higher = sums.select(F.col("key").alias("up"), F.col("up").alias("upper"))
        sums = materialize(sums.join(below, "key", "left").join(higher, "up", "left").select(
            "key", F.col("upper").alias("up"), (F.col("l") + F.coalesce("bl", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("bs", F.lit(0))).alias("s")),
            "trie-sums")
        far *= 2
    return whole.drop("l", "s").join(sums.select("key", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens")), "key")


def prefix_trie(conversations: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: ``conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``."""
    groups = distinct_segments(rebuilt_segments(numbered_turns(conversations), band))

    def run(table: pa.Table) -> pa.Table:
        return _shard_nodes(table, band)

    nodes = materialize(sharded(groups, shard_turns).groupBy("bucket").applyInArrow(run, OPEN_SCHEMA), "trie-nodes")
    merged = _merged(nodes)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = nodes.where("NOT open")
    named = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("found"))
    edge = closed.where("parent IS NOT NULL").drop("parent_conv_id").join(named, "parent").withColumnRenamed("found", "parent_conv_id")
    out = closed.where("parent IS NULL").select(columns).unionByName(edge.select(columns)).unionByName(merged.select(columns))
    return out.fillna({"ends_sha256": sha256(b"").hexdigest()})
