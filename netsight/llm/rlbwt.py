"""Suffix-array deduplication with a run-length compressed Burrows-Wheeler index.

``RunIndex`` keeps the transform of a block of text as runs, with the suffixes at run starts and
run ends alone; the suffix order itself is dropped once the runs are made. The last suffix of one
run and the first of the next are neighbours in it, so their common length is measured in the text,
and from these samples the longest matches stream on through the text, since within a run each is
one less than its predecessor's. A place whose longest match reaches the window's length starts a
repeated window.

The blocks come from the corpus by content (``zones``): equal windows of any two texts belong to
zones of one group, and a group's zones are indexed together. An equal zone is shipped once,
whatever the number of its copies, and all windows of a zone with copies are repeated; a group
with no other zone has nothing to be matched with, so it is not shipped at all. A group with more
than ``KINDS`` different zones is cut further, by the bytes that all windows of a cell have in
common, so that a passage in a third of all texts is spread by its surroundings. A cell with more
than ``KINDS`` pieces, like those over the ends of such a passage, has no bounded block: it is cut
into its windows, and equal windows are counted, before and after the shuffle.

What is shipped is written once, and the cells are counted in that table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import free, map_documents, mixed, shared, text_bytes
from netsight.llm.zones import corpus_zones, keyed, run_hashes, runs

WINDOW = 200
GRAM = 32
KINDS = 1000
CELL = 16
BLOCK_BYTES = 256 << 10


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The places of the suffixes in order, by prefix doubling among those that still tie."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(5):
        key = (key << np.uint64(8)) | padded[i:i + n]
    bits, depth = np.uint64(max(1, n.bit_length())), 5
    # The rank of a suffix is the first row of those that tie with it; past the end it is 0.
    order, ranks, rows = np.arange(n), np.zeros(n + 1, np.uint64), np.arange(n)
    while len(rows):
        at, width = order[rows], 40 if depth == 5 else 2 * int(bits)
        key = key if depth == 5 else (ranks[at] << bits) | ranks[np.minimum(at + depth // 2, n)]
        if width + int(bits) <= 64:
            packed = np.sort((key << bits) | np.arange(len(at), dtype=np.uint64))
            at = at[(packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
            packed >>= bits
        else:
            by = np.argsort(key, kind="stable")
            at, packed = at[by], key[by]
        order[rows] = at
        first = np.concatenate([[True], packed[1:] != packed[:-1]])
        ranks[at] = (rows[first][np.cumsum(first) - 1] + 1).astype(np.uint64)
        rows = rows[~(first & np.append(first[1:], True))]
        depth *= 2
    return order


class RunIndex:
    """A text's Burrows-Wheeler transform as runs, with the suffixes at their first and last rows.

    The suffix order is dropped once the runs are made; the samples of two runs side by side are
    each other's neighbours in it. The text must end in a symbol of its own.
    """

    def __init__(self, text: np.ndarray):
        self.n, order = len(text), suffix_order(text)
        self.text = np.concatenate([text, np.zeros(16, np.uint8)])
        symbols = text[order - 1].astype(np.int16)
        symbols[order == 0] = -1
        starts = np.flatnonzero(np.diff(symbols, prepend=-2) != 0)
        self.run_symbols, self.run_lengths = symbols[starts], np.diff(np.append(starts, self.n))
        self.first, self.last = order[starts], order[np.append(starts[1:], self.n) - 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the different suffixes at ``a`` and ``b`` share, eight at a time."""
        words = np.ndarray(self.n + 8, "<u8", self.text, strides=(1,))
        total, left = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(left):
            odd = words[a] ^ words[b]
            same = odd == 0
            # The lowest bit that differs lies in the first byte that does.
            lowest = odd & (~odd + np.uint64(1))
            total[left] += np.where(same, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3)
            left, a, b = left[same], a[same] + 8, b[same] + 8
        return total

    def matches(self) -> np.ndarray:
        """For every place, the length of its longest match that starts at another place.

        A run's first suffix is measured against the last of the run before, which holds for both;
        from a sample the match streams on, a symbol shorter with each place, to the next longer one.
        """
        a, b = self.first[1:], self.last[:-1]
        length, best = self.common(a, b), np.zeros(self.n, np.int64)
        for at in (a, b):
            reach = np.zeros(self.n, np.int64)
            np.maximum.at(reach, at, length + at)
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.n))
        return best


def repeated_starts(pieces: list[bytes], copies: list[int], window: int) -> list[np.ndarray]:
    """For each piece, which window starts are repeated within the block (or in its own copies)."""
    # No text holds 0xFF, so a window neither reaches past its piece nor starts in a border.
    text = b"".join(p + b"\xff" + i.to_bytes(4, "big") + b"\xff" for i, p in enumerate(pieces)) + b"\xfe"
    best = RunIndex(np.frombuffer(text, np.uint8)).matches()
    out, at = [], 0
    for piece, n in zip(pieces, copies, strict=True):
        out.append((best[at:at + max(0, len(piece) - window + 1)] >= window) | (n > 1))
        at += len(piece) + 6
    return out


def crowded_routes(pieces: DataFrame) -> DataFrame:
    """(route) of the cells with more than ``KINDS`` pieces, equal ones counted too."""
    return pieces.groupBy("route").agg(F.count("*").alias("pieces")).where(F.col("pieces") > KINDS).select("route")


def held(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """``rows`` whose key is in ``keys`` (with their ``times``); keys of many rows are few, and joined apart."""
    heavy = shared(keys.where(F.col("times") > KINDS).select(*names), "heavy")
    light = keys.where(F.col("times") <= KINDS).select(*names)
    return rows.join(heavy, [*names], "left_semi").union(rows.join(heavy, [*names], "left_anti").join(light, [*names], "left_semi"))


def window_marks(pieces: DataFrame, window: int) -> DataFrame:
    """Repeated window starts of ``pieces`` without an index, by counts of equal pieces and windows.

    All windows of a repeated piece are repeated; those of zones with copies are marked elsewhere. Different pieces are cut, and equal windows are
    one row with their count, told apart by 128 bits. Equal windows have one route, so none has
    a copy elsewhere.
    """
    keys = ["route", "pa", "pb"]
    pieces = pieces.withColumns({"pa": F.xxhash64("bytes"), "pb": F.xxhash64(F.lit(1), "bytes", F.octet_length("bytes"))})
    kinds = shared(pieces.groupBy(*keys).agg(F.sum("n").alias("times"), F.min(F.struct("group", "content", "skip")).alias("at"),
                                             F.min("bytes").alias("bytes")), "kinds")
    whole = held(pieces.where("n = 1").select(*keys, "group", "content", "skip", F.octet_length("bytes").alias("size")),
                 kinds.where("times > 1").select(*keys, "times"), *keys)
    whole = whole.select("group", "content", F.array("skip").alias("starts"), F.array(F.col("skip") + F.col("size") - (window - 1)).alias("ends"))

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.slice(lo, 500)
                raws = rows.column("bytes").to_pylist()
                counts = np.array([len(raw) - window + 1 for raw in raws], np.int64)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i:i + window]) for raw, n in zip(raws, counts.tolist(), strict=True) for i in range(n)), np.int64)
                at = np.repeat(np.arange(len(raws)), counts)
                places = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + rows.column("skip").to_numpy()[at]
                yield pa.RecordBatch.from_pydict({
                    "wa": pa.array(digests[::2]), "wb": pa.array(digests[1::2]), "place": pa.array(places.astype(np.int32)),
                    **{c: rows.column(c).take(pa.array(at)) for c in ("group", "content", "n")}})

    places = shared(kinds.select("bytes", "at.group", "at.content", "at.skip", F.least("times", F.lit(2)).cast("long").alias("n")).mapInArrow(
        cut, "wa long, wb long, place int, group long, content long, n long"), "windows")
    twice = shared(places.groupBy("wa", "wb").agg(F.sum("n").alias("times")).where("times > 1"), "twice")
    alone = held(places.where("n = 1"), twice, "wa", "wb").groupBy("group", "content").agg(F.collect_list("place").alias("starts"))
    return (whole.union(alone.select("group", "content", "starts", F.transform("starts", lambda x: x + 1)))
            .select("group", "content", F.lit(0).alias("skip"), "starts", "ends"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(distinct, starts): the distinct texts, and runs of their repeated window starts.

    ``distinct`` has (ka, kb, text); ``starts`` has (ka, kb, starts, ends), arrays of places.
    """
    found = shared(corpus_zones(docs, window, gram), "zones")
    distinct = keyed(docs).groupBy("ka", "kb").agg(F.min("text").alias("text"))
    kinds = shared(found.groupBy("group", "content").agg(
        F.min(F.struct("ka", "kb", "low", "high", "anchor")).alias("at"), F.sum("n").alias("n")), "kinds")
    groups = kinds.groupBy("group").agg(F.count("*").alias("kinds")).where("kinds > 1").select("group", (F.col("kinds") > KINDS).alias("large"))
    zone = F.struct("group", "content", "at.low", "at.high", "at.anchor", "n", "large")
    wanted = kinds.join(groups, "group").groupBy("at.ka", "at.kb").agg(F.collect_list(zone).alias("zones"))

    def ship(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw, bounds = data.tobytes(), offsets.tolist()
            for lo in range(0, batch.num_rows, 500):
                out = {"route": [], "group": [], "content": [], "n": [], "skip": [], "bytes": [], "cell": []}
                for i in range(lo, min(lo + 500, batch.num_rows)):
                    a, b = bounds[i], bounds[i + 1]
                    values = None
                    for z in batch.column("zones")[i].as_py():
                        if not z["large"]:
                            parts = [(z["group"], z["low"], z["high"])]
                        else:
                            if values is None:
                                values = data[a:b].astype(np.uint64) + np.uint64(1)
                            first, last = (z["low"] - z["anchor"]) // CELL, (z["high"] - z["anchor"]) // CELL
                            cells = np.arange(first, last + 1)
                            base = z["anchor"] + cells * CELL
                            core = run_hashes(values, base + CELL - 1, base + window)
                            key = mixed(core ^ mixed((np.uint64(z["group"] & (2**64 - 1)) + cells.astype(np.uint64)).copy())).view(np.int64)
                            parts = [(k, max(z["low"], s), min(z["high"], s + CELL - 1)) for k, s in zip(key.tolist(), base.tolist(), strict=True)]
                        for route, low, high in parts:
                            for name, value in (("route", route), ("group", z["group"]), ("content", z["content"]), ("n", z["n"]), ("skip", low - z["low"]), ("bytes", raw[a + low:a + high + window]), ("cell", z["large"])):
                                out[name].append(value)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, {"bytes": pa.binary(), "skip": pa.int32(), "cell": pa.bool_()}.get(k, pa.int64())) for k, v in out.items()})

    def index(batches):
        block, size, route = {}, 0, None

        def flush():
            pieces = list(block)
            if not pieces:
                return None
            marks = repeated_starts(pieces, [sum(o[2] for o in block[p]) for p in pieces], window)
            out = {"group": [], "content": [], "skip": [], "starts": [], "ends": []}
            for piece, flags in zip(pieces, marks, strict=True):
                if flags.any():
                    s, e = runs(flags)
                    for group, content, n, skip in block[piece]:
                        if n == 1:
                            for name, value in (("group", group), ("content", content), ("skip", skip), ("starts", s + skip), ("ends", e + skip)):
                                out[name].append(value)
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(pa.int32()) if k in ("starts", "ends") else pa.int32() if k == "skip" else pa.int64()) for k, v in out.items()})

        for batch in batches:
            for now, group, content, n, skip, raw in zip(*(batch.column(c).to_pylist() for c in ("route", "group", "content", "n", "skip", "bytes")), strict=True):
                if now != route and size > BLOCK_BYTES:
                    if (made := flush()) is not None:
                        yield made
                    block, size = {}, 0
                route = now
                if raw not in block:
                    block[raw] = []
                    size += len(raw) + 6
                block[raw].append((group, content, n, skip))
        if (made := flush()) is not None:
            yield made

    pieces = shared(distinct.join(wanted, ["ka", "kb"]).select("text", "zones").mapInArrow(
        ship, "route long, group long, content long, n long, skip int, bytes binary, cell boolean"), "pieces")
    crowded = shared(crowded_routes(pieces.where("cell")), "crowded")
    marks = (pieces.drop("cell").join(crowded, "route", "left_anti").repartition("route").sortWithinPartitions("route").mapInArrow(
        index, "group long, content long, skip int, starts array<int>, ends array<int>"))
    if not crowded.isEmpty():
        marks = marks.union(window_marks(pieces.where("cell").drop("cell").join(crowded, "route", "left_semi"), window))
    copied = kinds.where("n > 1").select("group", "content", F.lit(0).alias("skip"), F.array(F.lit(0)).alias("starts"),
                                         F.array(F.col("at.high") - F.col("at.low") + 1).alias("ends"))
    marks = copied.union(marks)
    add = lambda name: F.transform(name, lambda x: x + F.col("low"))
    starts = (found.select("group", "content", "ka", "kb", "low").join(marks, ["group", "content"])
              .select("ka", "kb", add("starts").alias("starts"), add("ends").alias("ends"))
              .groupBy("ka", "kb").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))
    return distinct, starts


def removed_spans(starts: list[int], ends: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans covered by the windows that start in [start, end)."""
    s, e = np.array(starts, np.int64), np.array(ends, np.int64) - 1 + window
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order]) if len(s) else e
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[new], e[np.append(new[1:], len(s)) - 1] if len(s) else e


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct texts (ka, kb, text) with the spans to remove: (lows, highs), in bytes."""
    distinct, starts = repeats(docs, window, gram)

    def run(batches):
        for batch in batches:
            made = [removed_spans(s or [], e or [], window) for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("ka", "kb", "text")},
                "lows": pa.array([m[0] for m in made], pa.list_(pa.int32())), "highs": pa.array([m[1] for m in made], pa.list_(pa.int32()))})

    return distinct.join(starts, ["ka", "kb"], "left").mapInArrow(run, "ka long, kb long, text string, lows array<int>, highs array<int>")


def kept_bytes(raw: bytes, lows: list[int], highs: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *highs], [*lows, len(raw)], strict=True))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of the bytes that stay.

    Every byte of a ``window``-byte string that starts at another place too goes, in all its
    places. Null and short texts lose nothing; equal texts of at least ``window`` bytes lose
    everything; equal rows are rows each; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            cut = list(zip(raws, batch.column("lows").to_pylist(), batch.column("highs").to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({
                "ka": batch.column("ka"), "kb": batch.column("kb"),
                "n_bytes": pa.array([len(r) for r in raws], pa.int64()),
                "n_removed": pa.array([sum(h) - sum(lo) for _, lo, h in cut], pa.int64()),
                "n_spans": pa.array([len(h) for _, _, h in cut], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(kept_bytes(*c)).hexdigest() for c in cut])})

    made = spans(docs, window, gram).mapInArrow(run, "ka long, kb long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return keyed(docs).select("doc_id", "ka", "kb").join(made, ["ka", "kb"]).drop("ka", "kb")


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the repeated bytes; characters stay whole, and texts that lose all go.

    Null and empty texts stay as they are, and so do all other columns, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lows_, highs_ = free(docs, "lows", "highs")
    cut = (spans(docs, window, gram).where(F.size("lows") > 0)
           .select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), F.col("lows").alias("_lows"), F.col("highs").alias("_highs")))
    # The given row travels as one column, so that its names meet none of these.
    rows = (docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("_b"))
            .join(cut, (F.col("_a") == F.col("_ka")) & (F.col("_b") == F.col("_kb")), "left")
            .select("_row.*", F.col("_lows").alias(lows_), F.col("_highs").alias(highs_)))

    def work(batch, data, offsets):
        raw, bounds, out, keep = data.tobytes(), offsets.tolist(), [], []
        for a, b, lows, highs in zip(bounds, bounds[1:], batch.column(lows_).to_pylist(), batch.column(highs_).to_pylist(), strict=False):
            if lows is None:
                out.append(None)
                keep.append(True)
                continue
            own = raw[a:b]
            # A span gives up the ends that are parts of characters.
            inner = [(_whole(own, lo, 1), _whole(own, hi, -1)) for lo, hi in zip(lows, highs, strict=True)]
            left = kept_bytes(own, [lo for lo, hi in inner if lo < hi], [hi for lo, hi in inner if lo < hi]).decode("utf-8")
            out.append(left)
            keep.append(left != "")
        return np.array(keep, bool), out

    return map_documents(rows, work).drop(lows_, highs_)


def _whole(raw: bytes, at: int, step: int) -> int:
    """The nearest place between characters, going this way."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at
