"""SimHash near-duplicates through a Gray-order hierarchical index.

Equal fingerprints are one row. Fingerprints at ``distance`` or fewer differing bits agree in at
least one of ``distance + 1`` blocks of bits, so each is sent to a bucket per block, and every
linked pair meets in a bucket. A bucket's fingerprints are sorted by Gray rank, which puts those
with common bits side by side; runs of ``FAN`` become nodes, runs of nodes upper nodes. A node
holds the bits that all below it share, less those its parent already holds. A search adds up
the differences on the way down and leaves out a whole node once they exceed the distance.

Buckets with more rows than ``SLAB`` are dealt to cells for pairs of parts, so that every pair
still meets and no task holds more than two parts. Links leave a bucket as a forest: one row for
each member at most, however many pairs there are. In large buckets, nodes that lie wholly in
the searcher's component are left out too, since they cannot add a link between different ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import map_texts, shared, texts
from netsight.llm.components import components
from netsight.llm.zones import keyed

SHINGLE = 4
DISTANCE = 4
SEED = 42
FAN = 8
SLAB = 20_000
SMALL = 256
SEARCHERS = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values of the lower-cased text's word shingles."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=False)], "<u8")
    return most_bits(h)


def most_bits(h: np.ndarray) -> int:
    """The bits that are set in over half of the numbers."""
    planes = h.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    counts = np.bincount(planes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keys: str) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed number; ``keys`` of the text stay."""

    def work(rows, data, offsets):
        raw, bounds = data.tobytes(), offsets.tolist()
        fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64)
        return {**{c: rows.column(c) for c in ("doc_id", *keys)}, "fp": pa.array(fps.view(np.int64))}

    schema = ", ".join(f"{c} long" for c in ("doc_id", *keys, "fp"))
    return map_texts(keyed(docs) if keys else texts(docs), "text", schema, work)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over buckets of fingerprints, both sorted; level 0 are the fingerprints."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        self.fps, self.bucket = fps, bucket
        pattern, held, owner = fps, np.full(len(fps), ~np.uint64(0)), bucket
        self.levels = []
        while True:
            change = np.flatnonzero(np.diff(owner, prepend=-1))
            place = np.arange(len(owner)) - np.repeat(change, np.diff(np.append(change, len(owner))))
            first = np.flatnonzero(place % FAN == 0)
            same = np.bitwise_and.reduceat(held, first) & ~(
                np.bitwise_or.reduceat(pattern, first) ^ np.bitwise_and.reduceat(pattern, first))
            parent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
            self.levels.append({"pattern": pattern, "own": held & ~same[parent], "first": first,
                                "count": np.diff(np.append(first, len(owner))), "parent": parent})
            pattern, held, owner = pattern[first] & same, same, owner[first]
            if len(first) == len(change):
                break
        self.roots = pattern, held
        self.root_of = np.searchsorted(owner, bucket)

    def marks(self, part: np.ndarray) -> list[np.ndarray]:
        """For each level above the leaves, the component that all leaves of a node are in, or -1."""
        out, now = [], part
        for level in self.levels:
            low, high = np.minimum.reduceat(now, level["first"]), np.maximum.reduceat(now, level["first"])
            now = np.where(low == high, low, -1)
            out.append(now)
        return out

    def search(self, who: np.ndarray, distance: int, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (searcher, later leaf) at ``distance`` or less; with ``part``, of different parts."""
        marks = self.marks(part) if part is not None else None
        node = self.root_of[who]
        pattern, held = self.roots
        far = np.bitwise_count((self.fps[who] ^ pattern[node]) & held[node]).astype(np.int16)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = far <= distance
            if marks is not None:
                keep &= marks[depth][node] != part[who]
            who, node, far = who[keep], node[keep], far[keep]
            count = level["count"][node]
            total = np.cumsum(count)
            child = np.arange(total[-1] if len(total) else 0) + np.repeat(level["first"][node] - (total - count), count)
            who, far = np.repeat(who, count), np.repeat(far, count)
            far = far + np.bitwise_count((self.fps[who] ^ level["pattern"][child]) & level["own"][child])
            node = child
        keep = (far <= distance) & (node > who)
        return who[keep], node[keep]


def joined(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of components after adding links; a label is the smallest place in a component."""
    while len(a):
        low = np.minimum(part[a], part[b])
        np.minimum.at(part, part[a], low)
        np.minimum.at(part, part[b], low)
        while (deeper := part[part] != part).any():
            part[deeper] = part[part[deeper]]
        apart = part[a] != part[b]
        a, b = a[apart], b[apart]
    return part


def forest(fps: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(member, chosen member of its component) for all that are linked within their bucket."""
    order = np.lexsort((gray_rank(fps), bucket))
    fps, bucket = fps[order], bucket[order]
    index, part = GrayIndex(fps, bucket), np.arange(len(fps))
    _, place, sizes = np.unique(bucket, return_inverse=True, return_counts=True)
    crowded = sizes[place] > SMALL
    few = np.flatnonzero(~crowded)
    for low in range(0, len(few), SEARCHERS):
        part = joined(part, *index.search(few[low:low + SEARCHERS], distance))
    for one in np.flatnonzero(sizes > SMALL):
        own = np.flatnonzero(place == one)
        alone, base = GrayIndex(fps[own], bucket[own]), own[0]
        inner = np.arange(len(own))
        for low in range(0, len(own), SMALL):
            inner = joined(inner, *alone.search(np.arange(low, min(low + SMALL, len(own))), distance, inner))
        part[own] = inner + base
    moved = np.flatnonzero(part != np.arange(len(part)))
    return fps[moved], fps[part[moved]]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Forest links (a, b) between the distinct fingerprints of ``fps`` (fp long)."""
    blocks = distance + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = [F.shiftrightunsigned("fp", low).bitwiseAND((1 << (high - low)) - 1) + F.lit(i << 40)
            for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = shared(rows.groupBy("key").count().where(F.col("count") > SLAB)
                   .select("key", F.ceil(F.col("count") / SLAB).cast("int").alias("parts")), "large")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = (rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("mine", mine).withColumn("other", other)
             .select("fp", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")))

    def run(batches):
        kept: list[np.ndarray] | None = None

        def made(columns):
            fps_, key, low, high = columns
            bucket = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)]))
            a, b = forest(fps_.view(np.uint64), bucket, distance)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "key", "low", "high")]
            if kept is not None:
                now = [np.concatenate(pair) for pair in zip(kept, now, strict=True)]
            last = np.all([c == c[-1] for c in now[1:]], axis=0) if len(now[0]) else np.zeros(0, bool)
            kept = [c[last] for c in now]
            if not last.all():
                yield made([c[~last] for c in now])
        if kept is not None and len(kept[0]):
            yield made(kept)

    return (cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
            .mapInArrow(run, "a long, b long"))


def rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """(node, root) of the fingerprints ``nodes`` (fp) that have links."""
    return shared(components(links(nodes.select("fp"), distance)), "roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id linked, step by step.

    Texts without words have fingerprint zero and are linked like any other; equal rows are
    rows each; a null doc_id never names a component unless all of it are null; an empty table
    gives no rows.
    """
    prints = shared(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = rooted(nodes, distance)
    named = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = shared(named.join(ids, "root").select("fp", "component_id"), "classes")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``part`` of ``found`` (doc_id, ka, kb, part), as it is.

    It is one with the smallest doc_id, null last, then with the smallest text key. Equal texts
    must be in one part. Rows equal in id and text are combined, so that one of them stays.
    """
    first = found.groupBy("part").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ka", "kb")).alias("at"))
    times = found.groupBy("doc_id", "ka", "kb").agg(F.count("*").alias("_times"))
    chosen = first.select(*[F.col(f"at.{c}").alias(f"_{c}") for c in ("doc_id", "ka", "kb")])
    chosen = shared(chosen.join(times, chosen["_doc_id"].eqNullSafe(times["doc_id"]) & (chosen["_ka"] == times["ka"])
                                & (chosen["_kb"] == times["kb"])).select("_doc_id", "_ka", "_kb", "_times"), "chosen")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The given row travels as one column, so that its names meet none of these.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_a"),
                       F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("_b"))
    same = F.col("_id").eqNullSafe(F.col("_doc_id")) & (F.col("_a") == F.col("_ka")) & (F.col("_b") == F.col("_kb"))
    lone = rows.join(chosen.where("_times = 1"), same, "left_semi")
    repeated = rows.join(chosen.where("_times > 1"), same, "left_semi").dropDuplicates(["_id", "_a", "_b"])
    return lone.union(repeated).select("_row.*")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs``, as it is, of each component: see ``keep_one``."""
    prints = shared(fingerprints(docs, shingle, "ka", "kb"), "fingerprints")
    roots = rooted(prints.select("fp").distinct(), distance)
    return keep_one(docs, prints.join(roots, prints["fp"] == roots["node"], "left")
                    .select("doc_id", "ka", "kb", F.coalesce("root", "fp").alias("part")))
