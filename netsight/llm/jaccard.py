"""Near-duplicates by the Jaccard similarity of their sets of word shingles.

Pairs are proposed twice and exact sets decide. First come the SimHash fingerprints of the sets, of
which the Gray index of ``simhash`` links those at four or fewer differing bits. Texts at 0.8 may
differ in 13 bits, so banded minima propose what is left: ``BANDS`` keys of ``ROWS`` minima each miss a
pair of similarity 0.8 with probability (1 - 0.8^4)^32, about 5 in 10^8, and fewer above it.
Equal sets are one node. First every node is held against the smallest of each of its buckets,
which settles groups of near copies with few pairs. Buckets that still hold different components
are then dealt to cells for pairs of parts of about ``SLAB`` shingles, where the pairs of
different components are compared, so that every proposed pair is tested or already linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import map_texts, mixed, odd_numbers, shared, small_batches, text_bytes, window_hashes, word_hashes
from netsight.llm.components import components
from netsight.llm.simhash import keep_one, most_bits
from netsight.llm.simhash import links as gray_links
from netsight.llm.zones import keyed

SHINGLE = 5
#: Pairs of at least 4/5.
PART, WHOLE = 4, 5
BANDS, ROWS = 32, 4
SLAB = 1 << 19
#: Of text at a time: what hashing takes beside it, some 40 times as much, stays with the worker.
HASHED_BYTES = 512 << 10
_FLIPS, _FACTORS = odd_numbers(BANDS * ROWS, 11), odd_numbers(BANDS * ROWS, 12)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's shingles as sorted 64-bit numbers; a shorter text is one shingle, one without words none."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words, begins = word_hashes(lower, offsets)
    windows = window_hashes(words, shingle)
    out = []
    for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False):
        if b - a >= shingle:
            out.append(np.unique(windows[a:b - shingle + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(words[a:b].tobytes())] if b > a else [], np.uint64))
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), 4096):
        low = np.minimum(low, ((own[at:at + 4096, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ low[row::ROWS])
    return key


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, ka, kb, node, n, fp, bands): node stands for the text's set of ``n`` shingles, fp is its SimHash."""

    def work(rows, data, offsets):
        sets = shingle_sets(data, offsets, shingle)
        return {**{c: rows.column(c) for c in ("doc_id", "ka", "kb")},
                "node": pa.array([node_of(s) for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "fp": pa.array(np.array([most_bits(s) for s in sets], np.uint64).view(np.int64)),
                "bands": pa.array([band_keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))}

    return map_texts(keyed(docs), "text", "doc_id long, ka long, kb long, node long, n long, fp long, bands array<long>", work,
                     HASHED_BYTES)


def alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` members, ``common`` in both, are similar enough."""
    return (PART + WHOLE) * common >= PART * (a + b)


def cross_links(nodes: np.ndarray, part: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join different ``part``s, by comparing all pairs of different ones."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    part = np.unique(part, return_inverse=True)[1].ravel()
    mark, out = np.zeros(codes.max() + 1, bool), []
    # Every pair of different components has a member outside the largest.
    for i in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
        if not (part != part[i]).any():
            break
        own = codes[bounds[i]:bounds[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[codes], bounds[:-1])
        mark[own] = False
        for j in np.flatnonzero(alike(common, sizes, sizes[i]) & (part != part[i])).tolist():
            if part[j] != part[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                part[part == part[j]] = part[i]
    return out


def gray_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the Gray index proposes for ``nodes`` (node, fp); nodes of one fingerprint meet its smallest."""
    first = shared(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    named = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}"))
    linked = gray_links(first.select("fp")).join(named("a"), "a").join(named("b"), "b").select("of_a", "of_b")
    equal = nodes.join(first, "fp").where("node <> first").select("first", "node")
    return linked.union(equal).select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()


def links(docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between the nodes of ``prints`` that give the components of all similar pairs."""
    nodes = prints.where("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("ka", "kb")).alias("at"))
    rows = nodes.select("node", "n", "at", F.explode("bands").alias("key"))
    least = rows.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("held")).where("held > 1")
    met = shared(rows.join(least, "key").select("key", "node", "n", "at", "least"), "buckets")
    own = shared(prints.where("n > 0").groupBy("node").agg(F.first("fp").alias("fp"), F.min(F.struct("ka", "kb")).alias("at")), "nodes")
    gray = shared(gray_pairs(own.select("node", "fp")), "gray")
    paired = own.join(gray.select("a").union(gray.select("b")).distinct().withColumnRenamed("a", "node"), "node", "left_semi")
    asked = met.select("at.ka", "at.kb").union(paired.select("at.ka", "at.kb")).distinct()
    found = keyed(docs).select("ka", "kb", "text").join(asked, ["ka", "kb"], "left_semi").groupBy("ka", "kb").agg(F.min("text").alias("text"))

    def ship(_, data, offsets):
        sets = shingle_sets(data, offsets, shingle)
        return {"node": pa.array([node_of(s) for s in sets], pa.int64()), "members": pa.array([s.tobytes() for s in sets], pa.binary())}

    sets = shared(map_texts(found, "text", "node long, members binary", ship, HASHED_BYTES), "sets")

    def compare(batches):
        for batch in batches:
            sides = [text_bytes(batch.column(c)) for c in ("x", "y")]
            keep = []
            for i in range(batch.num_rows):
                x, y = (data[ends[i]:ends[i + 1]].view(np.uint64) for data, ends in sides)
                keep.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    stars = met.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).union(gray).distinct()
    near = shared(stars.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
                  .join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
                  .select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "stars")
    roots = components(near)
    parted = shared(met.select("key", "node", "n").join(roots, "node", "left")
                    .select("key", "node", "n", F.coalesce("root", "node").alias("part")), "parted")
    mixed_keys = (parted.groupBy("key").agg(F.min("part").alias("one"), F.max("part").alias("two"), F.ceil(F.sum("n") / SLAB).cast("int").alias("slabs"),
                                            F.count("*").alias("held"))
                  # A bucket of two was compared already.
                  .where("one <> two AND held > 2").select("key", "slabs"))
    mine = F.pmod(F.xxhash64("node"), F.col("slabs")).cast("int")
    cells = (parted.join(mixed_keys, "key").withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
             .select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "part")
             .join(sets, "node"))

    def meet(cell: pa.Table) -> pa.Table:
        made = cross_links(cell.column("node").to_numpy(), cell.column("part").to_numpy(),
                           [np.frombuffer(m, np.uint64) for m in cell.column("members").to_pylist()])
        return pa.table({"a": pa.array([a for a, _ in made], pa.int64()), "b": pa.array([b for _, b in made], pa.int64())})

    rest = shared(cells.groupBy("key", "low", "high").applyInArrow(meet, "a long, b long"), "rest")
    return near.union(rest)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, ka, kb, part): rows of similar texts, step by step, have one ``part``."""
    with small_batches(docs.sparkSession):
        prints = shared(signatures(docs, shingle), "signatures")
        roots = shared(components(links(docs, prints, shingle)), "roots")
    return prints.join(roots, "node", "left").select("doc_id", "ka", "kb", F.coalesce("root", "node").alias("part"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` of each component of similar texts: the one with the smallest doc_id.

    Null texts, empty ones and those of white space alone have no shingles and equal one another, so
    one of them stays. Equal rows are one text; all columns stay as they are, whatever their names.
    """
    return keep_one(docs, near_duplicates(docs, shingle))
