"""Merkle manifest of a table: one tree per group, one over their roots, and a version of it for every changed row.

A leaf is the SHA-256 of a row's fields; every two consecutive nodes become one until one is left. The tree is persistent:
a changed row copies its ancestors only, and its version shares every other node with the manifest.

1. Leaves are hashed where the text is, once, and written without it. A range partitioning by group and order, and the
   number of rows of each group in each partition, give every leaf its position; no task orders a group.
2. Nodes go to aligned blocks of 2**bits positions. A block grows its own part of the tree; block roots are the leaves of
   the next tier, until each group has one root. The roots of all groups are the leaves of a last tree, grown alike.
3. Tier by tier downward, every block learns the steps from its root to the manifest's. They are the same for all rows
   of the block, so the upper tree is never spread over rows.
4. A block gives its rows their proofs. A changed leaf copies its path within the block, and its version goes on from the
   block's root, copying one ancestor for each step above.

Only leaves (a digest and an id) and blocks are shuffled. Blocks hold a set number of nodes; tiers grow with the logarithm.

Defined cases: a null field is ``-``, a null group is a group of its own and the first; null ids come first; rows of one
id are ordered by their leaves, and equal rows stand side by side; a group of one row is its own root; an empty table
gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, materialise, ship, tidy

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Positions of a block are 2**BITS; leaves of a range partition.
BITS, PART_ROWS = 8, 500_000
DIGEST = 32
#: First byte of a step: no sibling, sibling on the left, sibling on the right.
ALONE, LEFT, RIGHT = b"0", b"<", b">"


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row, as hex text: every field as the number of its bytes, a colon and its value."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of a proof lead to, as hex text, by expressions only."""
    sibling = lambda s: F.lower(F.hex(F.substring(s, 2, DIGEST)))
    side = lambda s: F.substring(s, 1, 1)
    joined = lambda a, s: F.when(side(s) == F.lit(LEFT), F.concat(sibling(s), a)).otherwise(F.concat(a, sibling(s)))
    return F.aggregate(proof, leaf, lambda a, s: F.sha2(joined(a, s).cast("binary"), 256))


def digest(*nodes: bytes) -> bytes:
    """Parent of nodes; their digests count as hex text."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def above(node: bytes, step: bytes) -> bytes:
    side, sibling = step[:1], step[1:]
    return digest(node) if side == ALONE else digest(sibling, node) if side == LEFT else digest(node, sibling)


class Block:
    """An aligned part of the tree: its levels from the bottom up. Nothing of it changes; a version is a list of copies."""

    def __init__(self, levels: list[list[bytes]]):
        self.levels = levels

    @classmethod
    def grow(cls, nodes: list[bytes], size: int, bits: int = BITS) -> Block:
        """size: nodes of the whole group on this tier. A block stops where the group's tree ends."""
        levels = [nodes]
        for _ in range(min(bits, (size - 1).bit_length())):
            below = levels[-1]
            levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
        return cls(levels)

    @classmethod
    def of(cls, packed: list[bytes]) -> Block:
        return cls([[level[i : i + DIGEST] for i in range(0, len(level), DIGEST)] for level in packed])

    def packed(self) -> list[bytes]:
        return [b"".join(level) for level in self.levels]

    def steps(self, place: int) -> list[bytes]:
        out = []
        for level in self.levels[:-1]:
            other = place ^ 1
            out.append(ALONE if other >= len(level) else (LEFT if place & 1 else RIGHT) + level[other])
            place >>= 1
        return out

    def version(self, leaf: bytes, steps: list[bytes]) -> list[bytes]:
        """The nodes that a version with another leaf has of its own: the leaf and one copy for each step."""
        copied = [leaf]
        for step in steps:
            copied.append(above(copied[-1], step))
        return copied


def positions(rows: DataFrame, order: list[str], tag: str, part_rows: int = PART_ROWS) -> DataFrame:
    """rows (grp, ...) with pos (from 0 within grp) and size (of grp), by grp and then the columns of order."""
    parts = ceil_div(rows.count(), part_rows)
    at, mask = F.monotonically_increasing_id(), F.lit((1 << 33) - 1)
    keys = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order]]
    sorted_ = materialise(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", at), tag)
    sorted_ = sorted_.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(mask))
    cells = sorted_.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")  # one row per range partition that holds some of the group
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size"))
    return sorted_.join(cells, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def grow(nodes: DataFrame, tag: str, bits: int) -> DataFrame:
    """grp, block, size, ids, levels, places and leaves (of changed ones), top: aligned blocks of nodes (grp, pos, size, node, id, changed)."""

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = Block.grow(table.column("node").to_pylist(), table.column("size")[0].as_py(), bits)
        changed = [(i, leaf) for i, leaf in enumerate(table.column("changed").to_pylist()) if leaf is not None]
        row = {
            "grp": key[0].as_py(), "block": key[1].as_py(), "size": table.column("size")[0].as_py(), "ids": table.column("id").to_pylist(), "levels": block.packed(),
            "places": [i for i, _ in changed], "leaves": [leaf for _, leaf in changed], "top": block.levels[-1][0],
        }
        return pa.Table.from_pylist([row], BLOCKS)

    blocks = nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("grp", "block")
    return materialise(blocks.applyInArrow(grown, "grp string, block long, size long, ids array<long>, levels array<binary>, places array<int>, leaves array<binary>, top binary"), tag)


BLOCKS = pa.schema([
    ("grp", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())),
    ("places", pa.list_(pa.int32())), ("leaves", pa.list_(pa.binary())), ("top", pa.binary()),
])
PATHS = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("steps", pa.list_(pa.binary()))])


def _paths(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block.of(row["levels"])
            rows = [{"grp": row["grp"], "block": row["block"], "pos": (row["block"] << bits) + i, "steps": block.steps(i)} for i in range(len(block.levels[0]))]
            yield pa.RecordBatch.from_pylist(rows, PATHS)


def climb(nodes: DataFrame, tag: str, bits: int) -> DataFrame:
    """grp, pos, steps, root: from every node (grp, pos, size, node) to its group's root, tier by tier."""
    tiers, none = [], F.array().cast("array<binary>")
    while not nodes.filter("size > 1").isEmpty():
        padded = nodes.select("grp", "pos", "size", "node", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("changed"))
        tiers.append(grow(padded, tag, bits))
        nodes = tiers[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / (1 << bits)).cast("long").alias("size"), F.col("top").alias("node"))
    up = nodes.select("grp", F.col("pos").alias("block"), none.alias("rest"), F.col("node").alias("root"))
    for blocks in reversed(tiers):
        down = blocks.select("grp", "block", "levels").mapInArrow(tidy(partial(_paths, bits=bits)), "grp string, block long, pos long, steps array<binary>")
        up = materialise(down.join(up, ["grp", "block"]).select("grp", F.col("pos").alias("block"), F.concat("steps", "rest").alias("rest"), "root"), f"{tag}-steps")
    return up.select("grp", F.col("block").alias("pos"), F.col("rest").alias("steps"), "root")


ROWS = pa.schema([
    ("id", pa.int64()), ("pos", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary()),
    ("proof", pa.list_(pa.binary())), ("copied", pa.list_(pa.binary())), ("folded_root", pa.binary()),
])


def _rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block, changed = Block.of(row["levels"]), dict(zip(row["places"], row["leaves"]))
            out = []
            for place, (id_, leaf) in enumerate(zip(row["ids"], block.levels[0])):
                steps = block.steps(place) + row["steps"]
                other = changed.get(place)
                copied = block.version(other, steps) if other is not None else None
                found = copied[-1] if copied else block.version(leaf, steps)[-1]
                out.append({"id": id_, "pos": (row["block"] << bits) + place, "leaf": leaf, "subroot": row["subroot"], "root": row["root"], "proof": steps, "copied": copied, "folded_root": found})
            yield pa.RecordBatch.from_pylist(out, ROWS)


def manifest(docs: DataFrame, changes: dict[str, Column], fields: tuple = FIELDS, group: str = "lang", id_: str = "doc_id", bits: int = BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of docs: id, pos (within its group), leaf, subroot, root, proof (steps to the root: a byte that tells the
    sibling's side, and its digest), copied (nodes of the version that changes the row, null where its leaf stays), folded_root
    (where the changed leaf, else the leaf itself, leads along the proof).

    changes: new values by column, as expressions on docs.
    """
    ship(docs.sparkSession)
    new = {f: changes.get(f, F.col(f"`{f}`")) for f in fields}
    grp = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    told = F.lit(False)
    for f in changes:
        told = told | ~new[f].eqNullSafe(F.col(f"`{f}`"))
    leaf, other = leaf_of([F.col(f"`{f}`") for f in fields]), F.when(told, leaf_of(list(new.values())))
    leaves = docs.select(grp.alias("grp"), F.col(id_).cast("long").alias("id"), F.unhex(leaf).alias("node"), F.unhex(other).alias("changed"))
    leaves = materialise(leaves.withColumn("turn", F.monotonically_increasing_id()), "merkle-leaves")
    blocks = grow(positions(leaves, ["id", "node", "turn"], "merkle-order", part_rows).drop("turn"), "merkle-blocks", bits)
    tops = blocks.select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / (1 << bits)).cast("long").alias("size"), F.col("top").alias("node"))
    paths = climb(tops, "merkle-tiers", bits)
    roots = paths.filter("pos = 0").select(F.col("grp").alias("of"), F.col("root").alias("node"), F.lit("").alias("grp"))
    ranked = materialise(positions(roots, ["of"], "merkle-groups", part_rows), "merkle-roots")
    to_root = climb(ranked.select("grp", "pos", "size", "node"), "merkle-root", bits).select("pos", F.col("steps").alias("last"), F.col("root").alias("whole"))
    last = ranked.select("of", "pos").join(to_root, "pos").drop("pos")
    outer = paths.select("grp", F.col("pos").alias("block"), F.col("root").alias("subroot"), "steps")
    outer = outer.join(last, F.col("grp") == F.col("of")).select("grp", "block", "subroot", F.concat("steps", "last").alias("steps"), F.col("whole").alias("root"))
    told = blocks.select("grp", "block", "ids", "levels", "places", "leaves").join(outer, ["grp", "block"])
    return told.select("block", "ids", "levels", "places", "leaves", "steps", "subroot", "root").mapInArrow(tidy(partial(_rows, bits=bits)), "id long, pos long, leaf binary, subroot binary, root binary, proof array<binary>, copied array<binary>, folded_root binary")
