"""Merkle manifest of a dataset, stored as aligned subtrees in van Emde Boas layout.

Every node has up to ``FANOUT`` children: consecutive nodes become one by the hash of their hex
digests, until one is left. The documents of a source are one tree; the sources' roots are the
leaves of another, whose root stands for the dataset.

A tree is cut into blocks, aligned subtrees of ``BLOCK_LEVELS`` steps. A block is one row of a
stored table with its digests in van Emde Boas order: the subtree is split at half its height, the
top part is stored first and then each bottom part, all by the same rule, so that a walk from leaf
to root stays in few lines of memory at any line size. ``address`` says where a node lies, for
construction and for the retrieval of siblings alike. Block roots are the leaves of the next level
of blocks, until a tree has a single one.

Proofs come down the same blocks: the siblings above a block are found once and handed to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import shared
from netsight.llm.ranks import ranked

FANOUT = 3
BLOCK_LEVELS = 6
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def size(levels: int) -> int:
    """Nodes of a full subtree of ``levels`` levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of one ``depth`` (0: the root) lie in the layout of ``levels`` levels."""
    base, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = FANOUT**(depth - top)
        part = index // below
        base, index = base + size(top) + part * size(levels - top), index - part * below
        depth, levels = depth - top, levels - top
    return base


def steps_for(count: int) -> int:
    """How often ``count`` nodes must be merged until one is left."""
    steps, width = 0, 1
    while width < count:
        steps, width = steps + 1, width * FANOUT
    return steps


def digest(hexes: str) -> str:
    return hashlib.sha256(hexes.encode()).hexdigest()


def build(leaves: Sequence[str]) -> bytes:
    """The digests of the subtree over ``leaves`` (hex), in layout order; slots without a node are zero."""
    levels, row = steps_for(len(leaves)) + 1, list(leaves)
    nodes = np.zeros((size(levels), 32), np.uint8)
    for depth in range(levels - 1, -1, -1):
        nodes[address(levels, depth, np.arange(len(row)))] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        row = [digest("".join(row[i:i + FANOUT])) for i in range(0, len(row), FANOUT)] if depth else row
    return nodes.tobytes()


def rows_of(nodes: bytes, count: int) -> list[list[str]]:
    """The digests (hex) of a stored subtree over ``count`` leaves, by steps above the leaves."""
    levels = steps_for(count) + 1
    table, out = np.frombuffer(nodes, np.uint8).reshape(-1, 32), []
    for step in range(levels):
        raw = table[address(levels, levels - 1 - step, np.arange(-(-count // FANOUT**step)))].tobytes().hex()
        out.append([raw[i:i + 64] for i in range(0, len(raw), 64)])
    return out


def siblings(rows: list[list[str]], index: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a leaf's ancestors in their runs, step by step below the root."""
    left, right = [], []
    for row in rows[:-1]:
        first = index - index % FANOUT
        left.append("".join(row[first:index]))
        right.append("".join(row[index + 1:first + FANOUT]))
        index //= FANOUT
    return left, right


def fold(leaf: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    for a, b in zip(left, right, strict=True):
        leaf = digest(a + leaf + b)
    return leaf


def field_text(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def _blocks(nodes: DataFrame, payload: dict[str, str]) -> DataFrame:
    """The stored blocks over ``nodes`` (tree, place, digest): one level of the manifest.

    A block has its number, its leaves' ``count``, the ``steps`` from leaf to root, the ``root``,
    the ``nodes`` in layout order, and the ``payload`` columns of its leaves as lists. The last
    block of a tree of many may hold few leaves; its root goes up alone as far as the others.
    """
    schema = "tree string, block long, count int, steps int, root string, nodes binary" + "".join(f", {c} array<{t}>" for c, t in payload.items())

    def make(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("place").to_numpy(), kind="stable"))).combine_chunks()
        leaves, block = table.column("digest").to_pylist(), int(table.column("block")[0].as_py())
        nodes, steps = build(leaves), steps_for(len(leaves))
        root = nodes[:32].hex()  # the root comes first at every height
        if block:
            for _ in range(BLOCK_LEVELS - steps):
                root = digest(root)
            steps = BLOCK_LEVELS
        lists = {c: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in payload}
        return pa.table({"tree": table.column("tree").slice(0, 1), "block": pa.array([block]), "count": pa.array([len(leaves)], pa.int32()),
                         "steps": pa.array([steps], pa.int32()), "root": pa.array([root]), "nodes": pa.array([nodes], pa.binary()), **lists})

    cut = nodes.select("tree", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "place", "digest", *payload)
    return cut.groupBy("tree", "block").applyInArrow(make, schema)


def manifest(nodes: DataFrame, payload: dict[str, str]) -> list[DataFrame]:
    """The levels of blocks of every tree in ``nodes`` (tree, place, digest), bottom first.

    The last level has one block for each tree. There is one pass for every ``BLOCK_LEVELS`` steps
    of the highest tree, over 1 / ``BLOCK`` of the rows of the pass before.
    """
    levels = [shared(_blocks(nodes, payload), "merkle")]
    while not levels[-1].where("block > 0").isEmpty():
        roots = levels[-1].select("tree", F.col("block").alias("place"), F.col("root").alias("digest"))
        levels.append(shared(_blocks(roots, {}), "merkle"))
    return levels


_PATH = "tree string, block long, left array<string>, right array<string>, subroot string, root string"


def _paths(row: dict) -> tuple[list[list[str]], list[list[str]], list[list[str]]]:
    """(digests by steps, left and right siblings of each leaf up to the root) of a block joined to its path."""
    rows = rows_of(row["nodes"], row["count"])
    alone = [""] * (row["steps"] - len(rows) + 1)
    made = [siblings(rows, i) for i in range(row["count"])]
    return rows, [[*a, *alone, *row["left"]] for a, _ in made], [[*b, *alone, *row["right"]] for _, b in made]


def _descend(level: DataFrame, paths: DataFrame, names: bool = False) -> DataFrame:
    """The paths of a level's leaves, from those of its blocks.

    The leaves are the blocks of the level below, or, with ``names``, the roots of other trees.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, left, right = _paths(row)
                n = row["count"]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array(row["name"] if names else [row["tree"]] * n, pa.string()),
                    "block": pa.array(np.zeros(n, np.int64) if names else row["block"] * BLOCK + np.arange(n)),
                    "left": pa.array(left, pa.list_(pa.string())), "right": pa.array(right, pa.list_(pa.string())),
                    "subroot": pa.array(rows[0] if names else [row["subroot"]] * n, pa.string()), "root": pa.array([row["root"]] * n)})

    return level.drop("root").join(paths, ["tree", "block"]).mapInArrow(run, _PATH)


def dataset(docs: DataFrame, forged: Column | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """The manifest of ``docs``: the levels of blocks of the sources' trees, and of the tree over the sources.

    ``forged`` is a text in place of a row's own, or null for none; the leaf it would have is kept
    beside the row's own, never in the tree. Leaves ascend by doc_id (null first), then by digest;
    equal rows are leaves each. The null source comes first, then sources by their bytes.
    """
    fields = [F.col(c) for c in FIELDS]
    claim = F.lit(None).cast("string") if forged is None else F.when(
        forged.isNotNull(), leaf_hash([*fields[:-1], forged]))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = shared(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                                leaf_hash(fields).alias("digest"), claim.alias("forged")), "leaves")
    of_docs = manifest(ranked(leaves, "tree", ["doc_id", "digest"], "place"), {"doc_id": "long", "forged": "string"})
    roots = shared(of_docs[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "subroots")
    return of_docs, manifest(ranked(roots, "tree", ["name"], "place"), {"name": "string"})


def proofs(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """Per document: leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is the siblings of the path from the leaf to the root; ``folded_root`` is what it
    makes of the row's leaf, or of the leaf its ``forged`` text has, and ``verified`` whether that
    is the root. Nulls in any field have a leaf too (``-``). An empty table gives no rows; other
    columns play no part. The manifest is written while the query is built.
    """
    of_docs, of_sources = dataset(docs, forged)
    none = F.array().cast("array<string>")
    paths = of_sources[-1].select("tree", "block", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), "root")
    for level in reversed(of_sources[1:]):
        paths = _descend(level, paths)
    paths = _descend(of_sources[0], paths, names=True)
    for level in reversed(of_docs[1:]):
        paths = _descend(level, paths)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, left, right = _paths(row)
                n = row["count"]
                folded = [fold(f or leaf, a, b) for f, leaf, a, b in zip(row["forged"], rows[0], left, right, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_id"], pa.int64()), "leaf": pa.array(rows[0]),
                    "subroot": pa.array([row["subroot"]] * n), "root": pa.array([row["root"]] * n),
                    "proof_sha256": pa.array([digest("".join(x + y for x, y in zip(a, b, strict=True))) for a, b in zip(left, right, strict=True)]),
                    "folded_root": pa.array(folded), "verified": pa.array([f == row["root"] for f in folded])})

    return of_docs[0].drop("root").join(paths, ["tree", "block"]).mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampering_found(docs: DataFrame) -> DataFrame:
    """``proofs`` where every document whose id has an even CRC-32 lost its line feeds; null ids and texts are left alone."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return proofs(docs, F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))))
