"""Merkle manifest of a dataset, with its trees cut into blocks in van Emde Boas layout.

Every tree is binary over its leaves in order; the last run of a level may be one node, which is
hashed alone. Aligned subtrees of `HEIGHT` levels above their leaves are blocks. A block stores its
nodes recursively split at half height: the upper half first, then every lower subtree from left to
right, each in the same layout. The address of a node follows from its depth and index alone, so
building and finding siblings need no pointers and touch few neighbouring stretches whatever the
size of a cache line or page. Block roots are the leaves of the next level of blocks, up to one.

Digests are hashed as hex text, as the manifest's contract says, and stored as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.llm.common import stored
from crivo.llm.ranking import ranked
from crivo.session import ship_package

#: Levels of a block above its leaves: a block holds at most 2^HEIGHT leaves, whatever the table.
HEIGHT = 10
DIGEST = 32


def leaf_digest(*columns: Column | str) -> Column:
    """SHA-256 as bytes of the columns: `-` for null, else UTF-8 byte count, colon and value."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def node_digest(children: Sequence[bytes]) -> bytes:
    """Parent of one or more nodes in order."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def fill(store: list[bytes], base: int, levels: int, values: list[bytes]) -> bytes:
    """Writes the subtree over `values` at `base` in van Emde Boas layout and returns its root.

    `levels` counts the leaves' level; values may be fewer than a full subtree's leaves, and nodes
    over none of them stay as they were.
    """
    if levels == 1:
        store[base] = values[0]
        return values[0]
    top = levels // 2
    bottom = levels - top
    leaves, nodes = 1 << (bottom - 1), (1 << bottom) - 1
    first = base + (1 << top) - 1
    roots = [
        fill(store, first + j * nodes, bottom, values[j * leaves : (j + 1) * leaves])
        for j in range(-(-len(values) // leaves))
    ]
    return fill(store, base, top, [node_digest(roots[k : k + 2]) for k in range(0, len(roots), 2)])


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes `index` of a depth (the root's is 0) in a subtree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    bottom = levels - top
    if depth < top:
        return address(top, depth, index)
    below = depth - top
    inside = address(bottom, below, index & ((1 << below) - 1))
    return (1 << top) - 1 + (index >> below) * ((1 << bottom) - 1) + inside


@lru_cache(maxsize=64)
def sibling_addresses(levels: int) -> np.ndarray:
    """For every leaf of a full subtree the addresses of its siblings, from the leaves' level up."""
    leaves = np.arange(1 << (levels - 1))
    rows = [address(levels, d, (leaves >> (levels - 1 - d)) ^ 1) for d in range(levels - 1, 0, -1)]
    return np.array(rows, dtype=np.int64).reshape(levels - 1, len(leaves)).T


def block_levels(size: int, height: int) -> int:
    """Levels of a block in a tree of `size` nodes: a tree that fits a block ends at its root."""
    return min(height, (size - 1).bit_length()) + 1


def block_paths(nodes: bytes, levels: int, count: int, positions: np.ndarray) -> list[tuple[bytes, str]]:
    """Siblings and sides of leaves, given by their place in the block, up to the block's root.

    Sides: `L` and `R` say where the sibling stands, `-` that a node is hashed alone.
    """
    places = sibling_addresses(levels)[positions]
    out = []
    for leaf, row in zip(positions.tolist(), places.tolist()):
        siblings, sides, many = [], [], count
        for at in row:
            if leaf & 1:
                sides.append("L")
                siblings.append(nodes[DIGEST * at : DIGEST * (at + 1)])
            elif leaf + 1 < many:
                sides.append("R")
                siblings.append(nodes[DIGEST * at : DIGEST * (at + 1)])
            else:
                sides.append("-")
            leaf, many = leaf >> 1, (many + 1) >> 1
        out.append((b"".join(siblings), "".join(sides)))
    return out


def fold(leaf: bytes, siblings: bytes, sides: str) -> bytes:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = node_digest([leaf])
            continue
        other = siblings[at : at + DIGEST]
        at += DIGEST
        leaf = node_digest([other, leaf] if side == "L" else [leaf, other])
    return leaf


def folded(leaf: str, siblings: str = "siblings", sides: str = "sides") -> Column:
    """`fold` of three columns."""

    @F.arrow_udf(T.BinaryType())
    def made(leaves: pa.Array, others: pa.Array, turns: pa.Array) -> pa.Array:
        rows = zip(leaves.to_pylist(), others.to_pylist(), turns.to_pylist())
        return pa.array([fold(*row) for row in rows], pa.binary())

    return made(F.col(leaf), F.col(siblings), F.col(sides))


@dataclass
class Forest:
    """Trees cut into blocks: `levels[k]` holds the blocks whose leaves are roots of level k - 1.

    A block is `tree`, `block`, `size` (nodes of its tree at its leaves' level), `count` (its own),
    `nodes` in van Emde Boas layout and `root`.
    """

    levels: list[DataFrame]
    height: int

    def roots(self) -> DataFrame:
        """`tree`, `subroot`, `level` of the block that holds it."""
        found = None
        for level, blocks in enumerate(self.levels):
            done = blocks.filter(F.col("size") <= 1 << self.height).select(
                "tree", F.col("root").alias("subroot"), F.lit(level).alias("level")
            )
            found = done if found is None else found.unionByName(done)
        return found


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks over rows `tree`, `position`, `size`, `digest`; a group has at most 2^height rows."""
    kind = nodes.schema["tree"].dataType.simpleString()
    keyed = nodes.withColumn("block", F.shiftright("position", height))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        size = table.column("size")[0].as_py()
        levels = block_levels(size, height)
        store = [bytes(DIGEST)] * ((1 << levels) - 1)
        root = fill(store, 0, levels, table.column("digest").to_pylist())
        first = table.slice(0, 1)
        return pa.table(
            {
                "tree": first.column("tree"),
                "block": first.column("block"),
                "size": first.column("size"),
                "count": pa.array([table.num_rows], pa.int32()),
                "nodes": pa.array([b"".join(store)], pa.binary()),
                "root": pa.array([root], pa.binary()),
            }
        )

    out = f"tree {kind}, block long, size long, count int, nodes binary, root binary"
    return keyed.groupBy("tree", "block").applyInArrow(build, out)


def build_forest(nodes: DataFrame, name: str, height: int = HEIGHT) -> Forest:
    """Blocks of every level over rows `tree`, `position` (from 0), `size` and `digest`.

    The driver learns one number, the size of the largest tree; a round of 2^height fewer nodes
    follows for each level it needs.
    """
    ship_package(nodes.sparkSession)
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels = [stored(_blocks(nodes, height), f"{name}-0")]
    while largest > 1 << height:
        largest = -(-largest >> height)
        above = levels[-1].filter(F.col("size") > 1 << height).select(
            "tree",
            F.col("block").alias("position"),
            F.shiftright(F.col("size") + F.lit((1 << height) - 1), height).alias("size"),
            F.col("root").alias("digest"),
        )
        levels.append(stored(_blocks(above, height), f"{name}-{len(levels)}"))
    return Forest(levels, height)


def _below(blocks: DataFrame, starts: DataFrame, height: int) -> DataFrame:
    """Paths of all leaves of blocks, from the paths of the blocks' roots.

    `starts`: `tree`, `block`, `siblings`, `sides`, `subroot`; the result has `position` for `block`.
    """
    kind = blocks.schema["tree"].dataType.simpleString()

    def paths(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = block_paths(r["nodes"], block_levels(r["size"], height), r["count"], np.arange(r["count"]))
                n, first = len(found), r["block"] << height
                yield pa.record_batch(
                    {
                        "tree": pa.array([r["tree"]] * n, batch.schema.field("tree").type),
                        "position": pa.array(range(first, first + n), pa.int64()),
                        "siblings": pa.array([s + r["siblings"] for s, _ in found], pa.binary()),
                        "sides": pa.array([s + r["sides"] for _, s in found], pa.string()),
                        "subroot": pa.array([r["subroot"]] * n, pa.binary()),
                    }
                )

    out = f"tree {kind}, position long, siblings binary, sides string, subroot binary"
    return _started(blocks, starts).mapInArrow(paths, out)


def _started(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    """Blocks beside the paths of their roots."""
    above = starts.select(F.col("tree").alias("__llm_tree"), F.col("block").alias("__llm_block"), "siblings", "sides", "subroot")
    same = F.col("tree").eqNullSafe(F.col("__llm_tree")) & (F.col("block") == F.col("__llm_block"))
    return blocks.join(above, same).select("tree", "block", "size", "count", "nodes", "siblings", "sides", "subroot")


def forest_paths(forest: Forest, roots: DataFrame) -> DataFrame:
    """Lowest blocks with the paths of their roots; `roots` are `Forest.roots()` with paths of their own."""
    inherited = None
    for level in range(len(forest.levels) - 1, -1, -1):
        starts = roots.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("block"), "siblings", "sides", "subroot")
        if inherited is not None:
            starts = starts.unionByName(inherited.withColumnRenamed("position", "block"))
        if level:
            inherited = stored(_below(forest.levels[level], starts, forest.height), f"paths-{level}")
    return _started(forest.levels[0], starts)


@dataclass
class Manifest:
    """Trees of a dataset, the tree over their roots, and the rows with their places.

    `members` has the rows' own columns, `tree`, `position`, `size` and `digest`; `trees` has
    `tree`, `subroot`, `level`, `position`; `root` is hex text, null for an empty dataset.
    """

    members: DataFrame
    forest: Forest
    trees: DataFrame
    top: Forest
    root: str | None


def build_manifest(rows: DataFrame, order: list[str], height: int = HEIGHT) -> Manifest:
    """Trees over rows with `tree` and `digest`, the leaves of each in the order of `order` (nulls first).

    Rows equal in `order` go by their digest, and rows equal in that too are interchangeable. The
    trees themselves stand in the order of `tree`, null first and strings by their UTF-8 bytes; a
    null tree is a tree of its own. An empty table has no root. All tables are written to the
    shared folder; a task holds one block.
    """
    members = stored(ranked(rows, "tree", [*order, "digest"], "leaves"), "members")
    forest = build_forest(members.select("tree", "position", "size", "digest"), "blocks", height)
    subroots = forest.roots().withColumns({"__llm_all": F.lit(0), "digest": F.col("subroot")})
    trees = stored(ranked(subroots, "__llm_all", ["tree"], "trees").drop("__llm_all"), "ranked-trees")
    nodes = trees.select(F.lit(0).alias("tree"), "position", "size", "digest")
    top = build_forest(nodes, "top", height)
    root = top.roots().select(F.lower(F.hex("subroot")).alias("root")).first()
    return Manifest(members, forest, trees.drop("digest", "size"), top, root and root.root)


def prove(manifest: Manifest) -> DataFrame:
    """The members with their proofs: `subroot`, `siblings` (32 bytes each, from the leaf up to the root) and `sides`.

    The paths of block roots go down block by block, so the upper part of a proof is computed once
    a block and not once a row; a group is one block and at most 2^height rows.
    """
    height = manifest.forest.height
    nothing = {"siblings": F.lit(b""), "sides": F.lit("")}
    top_roots = manifest.top.roots().withColumns(nothing)
    top_blocks = forest_paths(manifest.top, top_roots)
    first = top_blocks.select("tree", "block", "siblings", "sides", "subroot")
    upper = _below(manifest.top.levels[0], first, height).drop("tree", "subroot")
    roots = stored(manifest.trees.join(upper, "position").drop("position"), "tree-paths")
    blocks = forest_paths(manifest.forest, roots)
    members = manifest.members.withColumn("block", F.shiftright("position", height))

    def proofs(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.drop_columns(["block"])
        block = right.slice(0, 1).to_pylist()[0]
        places = left.column("position").to_numpy() & ((1 << height) - 1)
        found = block_paths(block["nodes"], block_levels(block["size"], height), block["count"], places)
        out = left.drop_columns(["block"])
        out = out.append_column("subroot", pa.array([block["subroot"]] * len(found), pa.binary()))
        out = out.append_column("siblings", pa.array([s + block["siblings"] for s, _ in found], pa.binary()))
        return out.append_column("sides", pa.array([s + block["sides"] for _, s in found], pa.string()))

    schema = T.StructType(
        [
            *manifest.members.schema.fields,
            T.StructField("subroot", T.BinaryType()),
            T.StructField("siblings", T.BinaryType()),
            T.StructField("sides", T.StringType()),
        ]
    )
    return members.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(proofs, schema)
