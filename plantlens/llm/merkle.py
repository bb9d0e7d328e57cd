"""Manifest of a dataset as a persistent Merkle tree, with a version for each tampered leaf.

A leaf is the digest of the row's fields. Leaves of one language ascend by doc_id; two consecutive nodes become their digest, a lone
last one the digest of itself, until one node (the subroot) remains. Subroots in order of language (null first, by UTF-8 bytes) become the root alike.
Digests are lowercase hexadecimal sha256 of hexadecimal texts joined without a mark.

Distribution: only ids and digests travel. Rows are numbered by a range sort and counts a partition; 2^LEVELS consecutive nodes are one
aligned block and one unit of work, so a language with a third of all rows is many units. Each round turns blocks into one node each,
until every tree has one; the tables of all rounds are kept. Then paths go down the same tables: a block learns the siblings above it
and hands each of its nodes its own. ``Block`` is persistent: a version of a changed leaf copies the leaf's ancestors inside the
block and shares every other node; above the block the version goes on by the siblings that came down, so upper versions are made where
their leaf is and no upper block gathers them.

Defined results: null fields are ``-``; an empty text is ``0:``; a null doc_id comes first in its language, rows with equal ids are ordered by
leaf, and fully equal rows may change places, which changes no digest. A null changed leaf means an untouched row. An empty table gives no rows.
Only the fields of the leaf are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 12  # of one block: 4,096 nodes
LEFT, RIGHT, LONE = "<", ">", "."  # first letter of a step: where the sibling stands, or that there is none
UPPER = [("steps", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]
UPPER_DDL = "steps array<string>, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(**changed: Column) -> Column:
    """Digest of the row's fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value; some may be replaced."""
    def field(name: str) -> Column:
        text = changed.get(name, F.col(name)).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*(field(name) for name in FIELDS)).cast("binary"), 256)


class Block:
    """The levels of one aligned block; they are never changed."""

    def __init__(self, hashes: list[str], height: int):
        self.levels = [hashes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def steps(self, at: int) -> list[str]:
        """Siblings from a leaf of the block up to its root."""
        found = []
        for level in self.levels[:-1]:
            if at & 1:
                found.append(LEFT + level[at - 1])
            else:
                found.append(RIGHT + level[at + 1] if at + 1 < len(level) else LONE)
            at >>= 1
        return found

    def version(self, at: int, leaf: str) -> list[str]:
        """Nodes that a tree with another leaf does not share with this one: the leaf and copies of its ancestors, upwards."""
        copied = [leaf]
        for level in self.levels[:-1]:
            pair = level[at & ~1 : (at | 1) + 1]
            pair[at & 1] = copied[-1]
            copied.append(digest("".join(pair)))
            at >>= 1
        return copied


def climb(node: str, steps: list[str]) -> list[str]:
    """The node and its ancestors along the steps."""
    found = [node]
    for step in steps:
        sibling = step[1:]
        found.append(digest(sibling + found[-1] if step[0] == LEFT else found[-1] + sibling))
    return found


def height(nodes: int, levels: int) -> int:
    """Levels a block has in a tree of so many nodes: all, or fewer when it is the only one."""
    return min(levels, (nodes - 1).bit_length())


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` by ``order``, and ``n``, the tree's rows.

    A running number breaks ties, so equal rows too are dealt to several ranges. The window sees one row for each partition of a tree.
    """
    keys = ["tree", *order, "tie"]
    tied = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "unordered")
    sorted_ = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = stored(sorted_, "ordered").withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    counts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n"))
    return placed.join(counts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block at a time; the input is sorted by (tree, block)."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != key:
                if held:
                    yield held
                held, key = [], (row["tree"], row["block"])
            held.append(row)
    if held:
        yield held


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels))


def _reduce(levels: int):
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            n = rows[0]["n"]
            root = Block([r["hash"] for r in rows], height(n, levels)).root
            yield pa.RecordBatch.from_pylist([{"tree": rows[0]["tree"], "pos": rows[0]["block"], "n": -(-n >> levels), "hash": root}], schema)

    return run


def grow(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (tree, pos, n, hash) of the rounds, from ``nodes`` up to one node a tree."""
    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        rows = _in_blocks(_with_block(tables[-1].select("tree", "pos", "n", "hash"), levels))
        tables.append(stored(rows.mapInArrow(_reduce(levels), "tree string, pos bigint, n bigint, hash string"), "nodes"))
        most = -(-most >> levels)
        if most <= 1:
            return tables


def _meet(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """The rows of a block, sorted, after the row of what lies above it (pos -1)."""
    above = upper.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "steps", "subroot", "root")
    return _in_blocks(_with_block(nodes, levels).unionByName(above, allowMissingColumns=True))


def _hand_down(levels: int):
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("hash", pa.string()), *UPPER])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, *rows in _blocks(batches):
            block = Block([r["hash"] for r in rows], height(rows[0]["n"], levels))
            yield pa.RecordBatch.from_pylist([
                {"tree": r["tree"], "pos": r["pos"], "hash": r["hash"], "steps": block.steps(i) + above["steps"], "subroot": above["subroot"], "root": above["root"]}
                for i, r in enumerate(rows)
            ], schema)

    return run


def paths(tables: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, hash, steps, subroot, root) of the nodes of the first table; ``top`` holds what lies above each tree (pos 0)."""
    for nodes in reversed(tables[:-1]):
        met = _meet(nodes.select("tree", "pos", "n", "hash"), top, levels)
        top = met.mapInArrow(_hand_down(levels), f"tree string, pos bigint, hash string, {UPPER_DDL}")
    return top


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())),
    ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("copied", pa.list_(pa.string())),
])
RESULT_DDL = (
    "doc_id bigint, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, "
    "verified boolean, copied array<string>"
)


def _judge(levels: int):
    """Proof and version of each leaf of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for above, *rows in _blocks(batches):
            block = Block([r["hash"] for r in rows], height(rows[0]["n"], levels))
            found = []
            for i, r in enumerate(rows):
                proof = block.steps(i) + above["steps"]
                if r["changed"] is None:
                    copied, folded = None, climb(r["hash"], proof)[-1]
                else:
                    copied = block.version(i, r["changed"])
                    copied += climb(copied[-1], above["steps"])[1:]
                    folded = copied[-1]
                found.append({
                    "doc_id": r["doc_id"], "leaf": r["hash"], "subroot": above["subroot"], "root": above["root"], "proof": proof,
                    "proof_sha256": digest("".join(step[1:] for step in proof)), "folded_root": folded, "verified": folded == above["root"], "copied": copied,
                })
            yield pa.RecordBatch.from_pylist(found, RESULT)

    return run


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof and version of every row.

    ``changed`` is the digest of a tampered row, null where nothing is tampered with. ``proof`` holds the steps from the leaf to the root: the
    side of the sibling and its digest. ``copied`` holds the nodes that the version of a tampered leaf has of its own, from leaf to root;
    ``folded_root`` is the root of that version, or the leaf folded with its siblings.
    """
    changed = F.lit(None).cast("string") if changed is None else changed
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_of().alias("hash"), changed.alias("changed"),
    )
    nodes = stored(numbered(leaves, ["doc_id", "hash"]), "leaves")
    tables = grow(nodes, levels)
    subroots = tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    order = stored(numbered(subroots, ["name"]), "subroots")
    upper = grow(order, levels)
    top = upper[-1].select("tree", "pos", F.array().cast("array<string>").alias("steps"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    below = paths(upper, top, levels).join(order.select("pos", "name"), "pos")
    below = below.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "steps", F.col("hash").alias("subroot"), "root")
    above = paths(tables[1:], stored(below, "above"), levels)
    return _meet(nodes, above, levels).mapInArrow(_judge(levels), RESULT_DDL)
