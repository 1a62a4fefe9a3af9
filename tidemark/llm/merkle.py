"""Operator 11, Merkle dataset manifest: an eight-fold hash tree over every row, with the authentication path of each.

Leaves are hashed by Spark where the rows are read.  They are ordered once by range and cut into aligned blocks of 4,096
leaves; all that follows sees a block at a time, and each level of blocks is a 4,096th of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.shared import stored

#: Children of a node; levels of a stacked subtree, of which a block has two.
FAN, LEVELS = 8, 2
#: What stands left and right of the path's node on one level: digests as hex text, one after the other.
STEP = "struct<left: string, right: string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts (text), concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields: `-` for a null, else the length in UTF-8 bytes, `:`, and the value as text."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def _parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Subtree:
    """A stacked subtree: levels of digests over up to FAN ** height nodes; it grows by any number of hashes at a time."""

    def __init__(self, nodes: list[str], height: int) -> None:
        self.levels: list[list[str]] = [nodes]
        self.height = height

    def grow(self, budget: int) -> bool:
        """Make up to budget nodes; whether the subtree is whole."""
        while len(self.levels) <= self.height:
            if len(self.levels) == 1 or len(self.levels[-1]) * FAN >= len(self.levels[-2]):
                self.levels.append([])
            below, here = self.levels[-2], self.levels[-1]
            while budget and len(here) * FAN < len(below):
                here.append(_parent(below[len(here) * FAN : (len(here) + 1) * FAN]))
                budget -= 1
            if len(here) * FAN < len(below):
                return False
            if len(self.levels) == self.height + 1:
                return True
        return True

    def whole(self) -> Subtree:
        self.grow(-1)
        return self

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def steps(self, k: int) -> list[dict[str, str]]:
        """Siblings of node k and of the nodes above it, below the subtree's root."""
        out = []
        for level in self.levels[: self.height]:
            first = k - k % FAN
            out.append({"left": "".join(level[first:k]), "right": "".join(level[k + 1 : first + FAN])})
            k //= FAN
        return out


@dataclass(frozen=True)
class Shape:
    """Leaves under a stacked subtree of so many levels, and under a block of two."""

    levels: int = LEVELS

    @property
    def sub(self) -> int:
        return FAN**self.levels

    @property
    def block(self) -> int:
        return self.sub * self.sub

    def blocks(self, leaves: int) -> int:
        return -(-leaves // self.block)

    def heights(self, leaves: int) -> tuple[int, int]:
        """Heights of the lower and upper subtrees of a block of a tree: full where it goes on above the block, else no higher than its leaves need."""
        if leaves > self.block:
            return self.levels, self.levels
        height = 0
        while FAN**height < leaves:
            height += 1
        return min(height, self.levels), max(0, height - self.levels)


def block_top(shape: Shape, leaves: list[str], size: int) -> tuple[list[str], str]:
    """Roots of a block's lower subtrees, and the block's own, in a tree of size leaves."""
    low, high = shape.heights(size)
    roots = [Subtree(leaves[k : k + shape.sub], low).whole().root for k in range(0, len(leaves), shape.sub)]
    return roots, Subtree(roots, high).whole().root


def block_paths(shape: Shape, leaves: list[str], roots: list[str], size: int) -> Iterator[list[dict[str, str]]]:
    """Paths of a block's leaves in turn, from the leaf to the block's root.

    Held are the upper subtree over the roots of the lower ones, the lower subtree that the current leaf is in, and the next one, which
    grows by a node with each path that goes out and takes over when the current one is used up.
    """
    (low, high), sub = shape.heights(size), shape.sub
    upper, now = Subtree(roots, high).whole(), Subtree(leaves[:sub], low).whole()
    for begin in range(0, len(leaves), sub):
        desired = Subtree(leaves[begin + sub : begin + 2 * sub], low)
        above = upper.steps(begin // sub)
        for k in range(len(now.levels[0])):
            yield now.steps(k) + above
            if desired.levels[0]:
                desired.grow(1)
        if desired.levels[0]:
            now = desired.whole()


def _with_tops(shape: Shape, blocks: DataFrame) -> DataFrame:
    """blocks with roots and top."""
    out = blocks.select("tree", "block", "size").sparkSession.createDataFrame([], "tree string, block long, size long, roots array<string>, top string").schema
    schema = to_arrow_schema(out)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [block_top(shape, leaves.as_py(), size.as_py()) for leaves, size in zip(batch["digests"], batch["size"], strict=True)]
            roots, top = pa.array([r for r, _ in rows], pa.list_(pa.string())), pa.array([t for _, t in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("tree", "block", "size")], roots.cast(schema.field("roots").type), top], schema=schema)

    return blocks.select("tree", "block", "size", "digests").mapInArrow(tops, out)


def _blocks(shape: Shape, nodes: DataFrame, extra: list[str]) -> DataFrame:
    """Nodes (tree, place, size, digest, *extra) by aligned block: one row, arrays in the order of place."""
    rows = F.sort_array(F.collect_list(F.struct("place", "digest", *extra)))
    grouped = nodes.groupBy("tree", "size", F.expr(f"place div {shape.block}").alias("block")).agg(rows.alias("rows"))
    return grouped.select("tree", "block", "size", F.col("rows.digest").alias("digests"), *[F.col(f"rows.{c}").alias(c) for c in extra])


def _climb(shape: Shape, tops: DataFrame, largest: int) -> DataFrame:
    """tree, block, above (path from the block's top to its tree's root) and root; largest is the leaves of the largest tree."""
    if largest <= shape.block:
        return tops.select("tree", "block", F.array().cast(f"array<{STEP}>").alias("above"), F.col("top").alias("root"))
    nodes = tops.select("tree", F.col("block").alias("place"), F.expr(f"(size - 1) div {shape.block} + 1").alias("size"), F.col("top").alias("digest"))
    blocks = stored(_blocks(shape, nodes, []), "merkle-nodes")
    held = stored(_with_tops(shape, blocks), "merkle-tops")
    paths = _paths(shape, blocks, held, _climb(shape, held, shape.blocks(largest)), [])
    return paths.select("tree", F.col("place").alias("block"), F.col("path").alias("above"), "root")


def _paths(shape: Shape, blocks: DataFrame, tops: DataFrame, above: DataFrame, extra: list[str]) -> DataFrame:
    """tree, place, digest, *extra, path and root of every node; above's paths end the nodes' own."""
    found = blocks.join(tops.select("tree", "block", "roots"), ["tree", "block"]).join(above, ["tree", "block"])
    own = [f"{c} {found.schema[c].dataType.elementType.simpleString()}" for c in extra]
    out = found.sparkSession.createDataFrame([], ", ".join(["tree string", "place long", "digest string", *own, f"path array<{STEP}>", "root string"])).schema
    schema = to_arrow_schema(out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch[c][k] for c in batch.schema.names}
                leaves, first = one["digests"].as_py(), one["block"].as_py() * shape.block
                above, own = one["above"].as_py(), {c: one[c].values for c in extra}
                paths = block_paths(shape, leaves, one["roots"].as_py(), one["size"].as_py())
                for begin in range(0, len(leaves), shape.sub):
                    part = leaves[begin : begin + shape.sub]
                    n = len(part)
                    columns = [pa.repeat(one["tree"], n), pa.array(range(first + begin, first + begin + n), pa.int64()), pa.array(part, pa.string())]
                    columns += [own[c].slice(begin, n) for c in extra]
                    columns += [pa.array([next(paths) + above for _ in part], schema.field("path").type), pa.repeat(one["root"], n)]
                    yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return found.select("tree", "block", "size", "digests", "roots", "above", "root", *extra).mapInArrow(walk, out)


def _placed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows, stored, with place (from 0) and size in their tree, ordered by keys.

    Rows are dealt by ranges of all keys and a last tie-break, so that no tree, however large, is one task, and no scan is asked twice:
    a row's number in its range is written with it, and what stands in earlier ranges is summed over ranges.
    """
    ranged = rows.repartitionByRange("tree", *keys, "tie").sortWithinPartitions("tree", *keys, "tie")
    held = stored(ranged.drop("tie").withColumn("number", F.monotonically_increasing_id()), name)
    part = F.shiftright("number", 33).alias("part")
    runs = held.groupBy("tree", part).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "size": F.sum("n").over(Window.partitionBy("tree"))})
    found = held.withColumn("part", part).join(runs.drop("n"), ["tree", "part"])
    return found.withColumn("place", F.col("base") + F.col("number") - F.col("first")).drop("number", "part", "base", "first")


def merkle_manifest(rows: DataFrame, leaf_col: str, group_col: str, order_col: str, carry: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """Every row's path in a hash tree: order_col, the columns of carry, leaf, tree, place, subroot, root and path.

    rows has the leaf's digest as hex text (see leaf_digest).  Of each group (group_col as text, null is a group) the leaves ascend by order_col,
    null first, and FAN consecutive nodes become a digest until one remains, the subroot; a lone leaf is its own.  Subroots
    ascend by group (null first, then bytewise) and become the root alike.  path is an array of the digests left and right on each level,
    from the leaf by the subroot to the root; folded() gives the root back, path_digest() its fingerprint.

    Rows of one group and order follow each other by digest, so repeated rows are leaves each and any order of reading gives the same tree; an empty
    table gives an empty result.  Carried columns keep their names, other columns are not read; texts play no part beyond their digests.
    """
    shape, own = Shape(levels), [f"c{k}" for k in range(len(carry or []))]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    slim = rows.select(tree.alias("tree"), F.col(order_col).alias("id"), F.col(leaf_col).alias("digest"), *[F.col(c).alias(k) for c, k in zip(carry or [], own, strict=True)])
    slim = stored(slim.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    placed = _placed(slim, ["id", "digest"], "merkle-ordered")
    blocks = stored(_blocks(shape, placed, ["id", *own]), "merkle-blocks")
    tops = stored(_with_tops(shape, blocks), "merkle-tops")
    lower = _climb(shape, tops, tops.agg(F.max("size")).first()[0] or 0)
    subroots = stored(lower.where("block = 0").select("tree", "root"), "merkle-subroots")
    # The trees' own tree: one node for each group, placed by name.
    nodes = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"), F.lit(0).alias("tie"))
    crown = stored(_blocks(shape, _placed(nodes, ["id"], "merkle-groups"), ["id"]), "merkle-crown")
    held = stored(_with_tops(shape, crown), "merkle-tops")
    over = _paths(shape, crown, held, _climb(shape, held, held.agg(F.max("size")).first()[0] or 0), ["id"])
    over = over.select(F.col("id").alias("tree"), F.col("path").alias("over"), F.col("root").alias("over_root"))
    above = lower.withColumnRenamed("root", "subroot").join(over, "tree")
    above = above.select("tree", "block", F.concat("above", "over").alias("above"), F.struct("subroot", F.col("over_root").alias("root")).alias("roots"))
    found = _paths(shape, blocks, tops, above.select("tree", "block", "above", F.to_json("roots").alias("root")), ["id", *own])
    both = F.from_json("root", "subroot string, root string")
    back = [F.col("id").alias(order_col), *[F.col(k).alias(c) for c, k in zip(carry or [], own, strict=True)]]
    return found.withColumn("both", both).select(*back, F.col("digest").alias("leaf"), F.expr("substr(tree, 2)").alias("tree"), "place", "both.subroot", "both.root", "path")


def verified(proofs: DataFrame, claimed: Column) -> DataFrame:
    """proofs with proof_sha256, folded_root (of the claimed leaf and the path) and verified (whether that is the root)."""
    out = proofs.withColumns({"proof_sha256": path_digest(F.col("path")), "folded_root": folded(claimed, F.col("path"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
