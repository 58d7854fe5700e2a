"""Merkle manifest of a table by butterfly exchange (operator 11).

Every row is a leaf; every ``fanout`` consecutive nodes of a tree become the
SHA-256 of their hex digests, level by level, until one node remains.

1. Leaves get their place within their tree from a range partitioning of the
   digests (``ranks.py``); texts are hashed where they are read and never move.
2. Aligned blocks of ``fanout ** k`` consecutive leaves are hashed in one task
   each, up to the block's root.
3. Butterfly: in round r the blocks that differ in digit r of their number (base
   ``fanout``) and agree in all others swap the roots they hold. Each of them
   then hashes the same ancestor for itself, so after the last round every block
   holds the tree's root and all upper siblings; nothing is sent downwards. The
   last subtree of a tree may have fewer blocks than its neighbours: its blocks
   answer for the missing ones as well, which adds fewer rows than there are
   blocks. A round is one shuffle of one row per block, in groups of ``fanout``.
4. Each block hashes its leaves again and puts the upper siblings behind its own.

The trees' roots, ordered by tree, are the leaves of one more tree, built by the
same steps.

Edge cases: NULL and empty values are told apart in a leaf; rows with equal ids
are ordered by their digests (equal rows are interchangeable); a NULL id comes
first; a tree of one leaf has that leaf as its root; an empty table gives an
empty manifest. Other columns of the input are not read.
"""
from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import rank_in_key

FANOUT = 2
#: Leaves hashed in one task at most: the block is the largest power of the
#: fanout up to this.
BLOCK_LEAVES = 4096

STEP = "struct<before:string,after:string>"


def field(column: Column) -> Column:
    """One value of a leaf: ``-`` for NULL, else its length in bytes, ``:`` and itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _parents(nodes: list[str], fanout: int) -> list[str]:
    return [sha256("".join(nodes[i:i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def _levels(digests: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """All levels, up to the given height, or until one node remains."""
    levels = [digests]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        levels.append(_parents(levels[-1], fanout))
    return levels


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _block_roots(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """``(tree, block, alone, joined)``: the root of a block that is a whole tree,
    and the root of one that is a part of a larger tree."""
    def run(table: pa.Table) -> pa.Table:
        digests = [d for _, d in sorted(zip(_column(table, "pos"), _column(table, "digest")))]
        return pa.table({"tree": table.column("tree")[:1], "block": table.column("block")[:1],
                         "alone": [_levels(digests, fanout, None)[-1][0]], "joined": [_levels(digests, fanout, height)[-1][0]]})

    return leaves.select("tree", "block", "pos", "digest").groupBy("tree", "block").applyInArrow(
        run, "tree string, block long, alone string, joined string")


def _butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """``(tree, block, blocks, root, path)``: the tree's root and the siblings of
    the block's ancestors, for every block."""
    sizes = roots.groupBy("tree").agg(F.count(F.lit(1)).alias("blocks"))
    state = materialize(roots.join(sizes, "tree").select(
        "tree", "block", "blocks", F.when(F.col("blocks") == 1, F.col("alone")).otherwise(F.col("joined")).alias("own"),
        F.array().cast(f"array<{STEP}>").alias("path")), "merkle-blocks")
    most = state.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        digit, low = F.expr(f"block div {width} % {fanout}"), F.expr(f"block % {width}")
        subtree = F.least(F.lit(width).cast("long"), F.col("blocks") - (F.col("block") - low))
        stands_in = (digit > 0) & (subtree < width)
        slots = F.when(stands_in, F.sequence(low, F.lit(width - 1).cast("long"), subtree)).otherwise(F.array(low))
        group = Window.partitionBy("tree", "above", "slot")
        state = (state.withColumns({"digit": digit, "low": low, "above": F.expr(f"block div {width * fanout}"), "slot": F.explode(slots)})
                 .withColumn("swapped", F.array_sort(F.collect_list(F.struct("digit", "own")).over(group)))
                 .where("slot = low"))
        side = {name: F.array_join(F.transform(F.filter("swapped", keep), lambda s: s["own"]), "") for name, keep in (
            ("before", lambda s: s["digit"] < F.col("digit")), ("after", lambda s: s["digit"] > F.col("digit")))}
        climbs = F.col("blocks") > width
        state = state.withColumns(side).select(
            "tree", "block", "blocks",
            F.when(climbs, F.sha2(F.concat("before", "own", "after"), 256)).otherwise(F.col("own")).alias("own"),
            F.when(climbs, F.concat("path", F.array(F.struct("before", "after")))).otherwise(F.col("path")).alias("path"))
        width *= fanout
    return state.withColumnRenamed("own", "root")


def _leaf_proofs(leaves: DataFrame, blocks: DataFrame, keep: list[str], fanout: int, height: int) -> DataFrame:
    """Columns ``keep``, ``tree``, ``digest`` and the block's ``subroot`` and
    ``root``, with ``proof``: the siblings within the block, then the block's path."""
    def run(table: pa.Table, block: pa.Table) -> pa.Table:
        n = table.num_rows
        order = sorted(range(n), key=_column(table, "pos").__getitem__)
        table = table.take(pa.array(order, pa.int64()))
        levels = _levels(_column(table, "digest"), fanout, None if block.column("blocks")[0].as_py() == 1 else height)
        upper = block.column("path")[0].as_py()
        upper_before, upper_after = [s["before"] for s in upper], [s["after"] for s in upper]
        before: list[str] = []
        after: list[str] = []
        for i in range(n):
            for level in levels[:-1]:
                first = i - i % fanout
                before.append("".join(level[first:i]))
                after.append("".join(level[i + 1:first + fanout]))
                i //= fanout
            before += upper_before
            after += upper_after
        steps = len(levels) - 1 + len(upper)
        offsets = pa.array([k * steps for k in range(n + 1)], pa.int32())
        sides = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        same = {x: pa.array([block.column(x)[0].as_py()] * n, pa.string()) for x in ("subroot", "root")}
        return pa.table({x: table.column(x) for x in [*keep, "tree", "digest"]} | same
                        | {"proof": pa.ListArray.from_arrays(offsets, sides)})

    kinds = dict(leaves.dtypes)
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in [*keep, "tree", "digest"]) + f", subroot string, root string, proof array<{STEP}>"
    return (leaves.select(*keep, "tree", "block", "pos", "digest").groupBy("tree", "block")
            .cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema))


def merkle_manifest(rows: DataFrame, order: list[str], keep: list[str], fanout: int = FANOUT,
                    block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """The manifest of ``rows`` ``(tree, digest, ...)``, one row each: columns
    ``keep``, ``leaf``, ``subroot`` (of the row's tree), ``root`` (of all trees in
    ascending order) and ``proof``, the siblings from the leaf up to the root.
    ``tree`` holds no NULLs; leaves ascend by ``order``, then digest."""
    height, size = 0, 1
    while size * fanout <= block_leaves:
        height, size = height + 1, size * fanout
    in_block = F.expr(f"pos div {size}")
    leaves = rank_in_key(rows.select(*dict.fromkeys(["tree", "digest", *order, *keep])), "tree", [*order, "digest"]).withColumn("block", in_block)
    blocks = materialize(_butterfly(_block_roots(leaves, fanout, height), fanout), "merkle-paths")
    roots = blocks.where("block = 0").select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("root").alias("digest"))
    tops = rank_in_key(roots, "tree", ["name"]).withColumn("block", in_block)
    top_blocks = _butterfly(_block_roots(tops, fanout, height), fanout).withColumn("subroot", F.col("root"))
    upper = _leaf_proofs(tops, top_blocks, ["name"], fanout, height).select(
        F.col("name").alias("tree"), F.col("root").alias("top"), F.col("proof").alias("top_path"))
    blocks = blocks.join(upper, "tree").select(
        "tree", "block", "blocks", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "top_path").alias("path"))
    return _leaf_proofs(leaves, blocks, keep, fanout, height).select(
        *keep, F.col("digest").alias("leaf"), "subroot", "root", "proof")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, digest, tampered)`` of ``documents``: trees are languages
    (NULL first), ``tampered`` is the digest after the test's change to
    ``n_chars``, for the rows it touches."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(columns)]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf_digest(columns).alias("digest"), F.when(touched, leaf_digest(changed)).alias("tampered"))
