"""Merkle dataset manifest: hash trees stored block by block in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import stored
from adledger.operators.scan import in_ranges, numbered, part_starts, running

FAN = 8
#: Levels of a stored block; it has at most FAN ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK = "tree bigint, block bigint, n bigint, leaves int, nodes binary, root string"
PATH = "tree bigint, block bigint, left array<string>, right array<string>"


class Manifest(NamedTuple):
    """``rows``: tree, pos, doc_id, lang, leaf, claimed, n, one per document. ``tiers``: tables
    of blocks, from the leaves up, of the trees of all languages. ``tops``: the same of the one
    tree over their roots. ``subroots``: tree, root. ``root``: one row, none without documents."""

    rows: DataFrame
    tiers: list[DataFrame]
    subroots: DataFrame
    tops: list[DataFrame]
    root: DataFrame


# --- address arithmetic -----------------------------------------------------

def tree_size(rows: int) -> int:
    """Nodes of a complete tree of so many rows of nodes."""
    return (FAN ** rows - 1) // (FAN - 1)


def address(depth: int, index: np.ndarray, rows: int) -> np.ndarray:
    """Places of the nodes ``index`` of row ``depth`` (0: the root) in van Emde Boas order.

    A tree is cut at half its height. The upper part is stored first, then each of the
    subtrees below it, all in the same order themselves; so a walk from any leaf to the root
    touches few runs of memory whatever the size of a cache line or page.
    """
    base = np.zeros(len(index), np.int64)
    while rows > 1:
        top = rows // 2
        if depth < top:
            rows = top
            continue
        below = rows - top
        width = FAN ** (depth - top)
        base += tree_size(top) + index // width * tree_size(below)
        index, depth, rows = index % width, depth - top, below
    return base


def layout(levels: int) -> list[np.ndarray]:
    """Places of all nodes of a block, by depth."""
    return [address(depth, np.arange(FAN ** depth), levels + 1) for depth in range(levels + 1)]


def counts_of(leaves: int, levels: int) -> list[int]:
    """Nodes in use by depth; only the last run of a row can be short."""
    counts = [leaves]
    for _ in range(levels):
        counts.append(-(-counts[-1] // FAN))
    return counts[::-1]


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves until one node remains, or a block is full."""
    levels = 0
    while levels < BLOCK_LEVELS and FAN ** levels < n:
        levels += 1
    return levels


def digest(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def build_block(leaves: list[str], levels: int) -> np.ndarray:
    """Nodes of a block in van Emde Boas order; places right of the last leaf stay empty."""
    nodes, places = np.zeros(tree_size(levels + 1), "S64"), layout(levels)
    row = leaves
    for depth in range(levels, -1, -1):
        nodes[places[depth][: len(row)]] = row
        if depth:
            row = [digest("".join(row[i:i + FAN]).encode()) for i in range(0, len(row), FAN)]
    return nodes


def walks(block: dict) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf of a stored block: digests left and right of its way to the block's root,
    level by level, and then of the block's own way up (``left``, ``right``)."""
    nodes = np.frombuffer(block["nodes"], "S64")
    levels = levels_of(block["n"])
    counts, places = counts_of(block["leaves"], levels), layout(levels)
    for leaf in range(block["leaves"]):
        left, right = [], []
        at = leaf
        for depth in range(levels, 0, -1):
            first = at - at % FAN
            run = nodes[places[depth][first:min(first + FAN, counts[depth])]]
            left.append(run[: at - first].tobytes().decode())
            right.append(run[at - first + 1:].tobytes().decode())
            at //= FAN
        yield left + block["left"], right + block["right"]


# --- construction -----------------------------------------------------------

def leaf_digest(fields: tuple[str, ...], changed: dict[str, Column] | None = None) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    parts = []
    for name in fields:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of one tier from (tree, pos, digest, n); a group is one block, so it is bounded."""
    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group["pos"]))
        leaves = group["digest"].take(pa.array(order)).to_pylist()
        n = group["n"][0].as_py()
        nodes = build_block(leaves, levels_of(n))
        return pa.table({
            "tree": group["tree"][:1], "block": group["block"][:1], "n": group["n"][:1],
            "leaves": pa.array([len(leaves)], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary()),
            "root": pa.array([nodes[0].decode()]),
        })

    keyed = rows.select("tree", F.expr(f"pos div {FAN ** BLOCK_LEVELS}").alias("block"), "pos", "digest", "n")
    return keyed.groupBy("tree", "block").applyInArrow(build, BLOCK)


def _tiers(rows: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All tiers over (tree, pos, digest, n), and (tree, root); ``most`` is the largest n.

    The roots of full blocks are the leaves of the next tier, until a tree fits in a block.
    """
    full = FAN ** BLOCK_LEVELS
    tiers, ended = [], None
    while True:
        tier = stored(_blocks(rows), "blocks")
        tiers.append(tier)
        done = tier.where(F.col("n") <= full).select("tree", "root")
        ended = done if ended is None else ended.union(done)
        if most <= full:
            return tiers, ended
        most = -(-most // full)
        rows = tier.where(F.col("n") > full).select(
            "tree", F.col("block").alias("pos"), F.col("root").alias("digest"), F.ceil(F.col("n") / full).cast("bigint").alias("n"))


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, claimed_where: Column | None = None,
             fields: tuple[str, ...] = FIELDS, key: str = "lang", order: str = "doc_id") -> Manifest:
    """The trees of ``docs``: one for each value of ``key`` over its rows by ``order``, and one over their roots.

    ``claimed`` are changed fields of the rows that hold ``claimed_where``; their digest is kept
    beside the true one for :func:`proofs` to check. Null keys and ids come first, and rows with the same id by
    their digest; repeated rows are leaves of their own. An empty table has no root. Columns
    other than ``fields`` are ignored.
    """
    both = docs.select(
        F.col(order).cast("bigint").alias("doc_id"),
        # sorts as the key does, null first, and is never null itself
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("lang"),
        leaf_digest(fields).alias("leaf"),
        F.when(F.lit(False) if claimed_where is None else claimed_where, leaf_digest(fields, claimed)).alias("claimed"))
    ranged = in_ranges(stored(both, "digests"), ["lang"], _order())
    starts = part_starts(ranged, ["lang"])
    sizes = stored(starts.groupBy("lang").agg(F.sum("_sum").alias("n")), "sizes")
    trees = stored(numbered(sizes, [], [F.col("lang")], "tree"), "trees")
    most = trees.agg(F.max("n"), F.count("*")).first()
    rows = stored(running(ranged, starts.join(trees, "lang"), ["lang"], _order(), "pos"), "leaves")
    tiers, subroots = _tiers(rows.select("tree", "pos", F.col("leaf").alias("digest"), "n"), most[0] or 0)
    subroots = stored(subroots, "subroots")
    over = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"),
                           F.col("root").alias("digest"), F.lit(most[1]).cast("bigint").alias("n"))
    tops, root = _tiers(over, most[1])
    return Manifest(rows, tiers, subroots, tops, root.select("root"))


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("claimed")]


# --- retrieval --------------------------------------------------------------

def _children(blocks: DataFrame) -> DataFrame:
    """Paths of the leaves of blocks, which are the blocks of the tier below, from the blocks' own paths."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, pairs = row["block"] * FAN ** BLOCK_LEVELS, list(walks(row))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["tree"]] * len(pairs), pa.int64()),
                    pa.array(range(first, first + len(pairs)), pa.int64()),
                    pa.array([p[0] for p in pairs], pa.list_(pa.string())),
                    pa.array([p[1] for p in pairs], pa.list_(pa.string()))], ["tree", "block", "left", "right"])

    return blocks.mapInArrow(walk, PATH)


def _paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, left, right): siblings on the way from each block of the lowest tier to the top.

    ``above`` has the same for the roots of whole trees, with block 0. From the highest tier
    down, a block hands its own path to the blocks below, each with its siblings put first.
    """
    full, paths = FAN ** BLOCK_LEVELS, None
    for tier in reversed(tiers):
        ends = tier.where(F.col("n") <= full).select("tree", "block").join(above, ["tree", "block"])
        paths = ends if paths is None else ends.unionByName(paths)
        if tier is not tiers[0]:
            paths = stored(_children(tier.drop("root").join(paths, ["tree", "block"])), "paths")
    return paths


def _checked(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Proof and folded root of each row in (tree, block) with the block's nodes, path and subroot."""
    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.to_pylist()[0]
        left = left.sort_by("pos")
        proofs, folded = [], []
        nodes = zip(left["leaf"].to_pylist(), left["claimed"].to_pylist(), strict=True)
        for (before, after), (leaf, claimed) in zip(walks(block), nodes, strict=True):
            proofs.append(digest("".join(a + b for a, b in zip(before, after, strict=True)).encode()))
            node = claimed or leaf
            for a, b in zip(before, after, strict=True):
                node = digest((a + node + b).encode())
            folded.append(node)
        return pa.table({
            "doc_id": left["doc_id"], "leaf": left["leaf"], "subroot": pa.array([block["subroot"]] * len(folded)),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)})

    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(
        check, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")


def top_paths(made: Manifest) -> DataFrame:
    """(tree, block 0, left, right): siblings from each tree's root up to the root of all."""
    spark = made.rows.sparkSession
    start = spark.range(1).select(F.lit(0).cast("bigint").alias("tree"), F.lit(0).cast("bigint").alias("block"),
                                  F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"))
    lowest = made.tops[0]
    paths = _paths(made.tops, start)
    leaves = _children(lowest.drop("root").join(paths, ["tree", "block"]))
    return leaves.select(F.col("block").alias("tree"), F.lit(0).cast("bigint").alias("block"), "left", "right")


def proofs(made: Manifest) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is H of all siblings on the way to the root. ``folded_root`` is recomputed from
    the claimed digest (the true one without a claim) and those siblings. A task handles one
    block of at most FAN ** BLOCK_LEVELS documents with one path above it.
    """
    paths = _paths(made.tiers, top_paths(made))
    blocks = made.tiers[0].drop("root").join(paths, ["tree", "block"]).join(
        made.subroots.withColumnRenamed("root", "subroot"), "tree")
    rows = made.rows.withColumn("block", F.expr(f"pos div {FAN ** BLOCK_LEVELS}"))
    out = _checked(rows, stored(blocks, "paths")).withColumn("root", made.root.scalar())  # one row
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
