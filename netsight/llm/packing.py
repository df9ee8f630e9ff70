"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Lengths are counted in a histogram, which has at most ``room`` entries however many documents
there are. Patterns of few lengths that fill a sequence are enumerated on a coarse grid, their
repeat counts are fitted to the histogram by non-negative least squares and rounded, and each
pattern is filled with exact lengths, the largest of each grid cell first and best fit for what
is left. Lengths that no pattern took are packed by best fit alone. The result is a list of
(exact lengths, repeats); every piece then finds its place from its rank among equal lengths.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsight.llm.common import map_texts, shared, texts
from netsight.llm.tokens import encoder

ROOM = 4096
END_ID = 1
GRID = 32
MOST_PARTS = 4
RANK_GROUP = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``room`` tokens: each text's ids, ``end_id`` after them.

    A null or empty text is one piece that holds ``end_id`` alone. Only texts longer than
    ``room`` are cut, so no task holds more than one text's ids beside its slice.
    """

    def work(rows, data, offsets):
        ids, offs = encoder(vocabulary).encode(data, offsets)
        doc_ids, out = rows.column("doc_id").to_pylist(), [[], [], [], [], []]
        for doc_id, low, high in zip(doc_ids, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            own = np.append(ids[low:high], end_id).astype("<u4")
            for piece, start in enumerate(range(0, len(own), room)):
                part = own[start:start + room]
                for values, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    values.append(value)
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"),
                        (pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)), strict=True))

    return map_texts(texts(docs), "text", PIECES, work)


def patterns(cells: int, parts: int) -> Iterator[tuple[int, ...]]:
    """Non-increasing runs of at most ``parts`` cell numbers from 1 with the sum ``cells``."""

    def extend(left: int, largest: int, most: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif most:
            for first in range(min(left, largest), 0, -1):
                for rest in extend(left - first, first, most - 1):
                    yield (first, *rest)

    return extend(cells, cells, parts)


def non_negative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The x >= 0 that makes a x closest to b: variables enter one by one, by the gradient."""
    free, x = np.zeros(a.shape[1], bool), np.zeros(a.shape[1])
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = 0
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[best] = True
        while free.any():
            inner = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (inner > 0).all():
                x[:] = 0
                x[free] = inner
                break
            where = np.flatnonzero(free)
            low = inner <= 0
            step = min(x[where[low]] / np.maximum(x[where[low]] - inner[low], 1e-300))
            x[where] += step * (inner - x[where])
            stuck = where[low][x[where[low]] <= 1e-12]
            free[stuck if len(stuck) else where[low]] = False
            x[~free] = 0
    return x


class Stock:
    """Lengths still to be packed, with counts."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c}
        self.lengths = sorted(self.counts)

    def largest(self, most: int, least: int = 0) -> int | None:
        """The largest length from ``least`` to ``most``."""
        i = bisect.bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i and self.lengths[i - 1] >= least else None

    def fill(self, taken: dict[int, int], used: int, room: int) -> None:
        """Add to ``taken`` the best fit for the free space, again and again."""
        at = room - used
        while at > 0 and (n := self.largest(at)) is not None:
            left = self.counts[n] - taken.get(n, 0)
            if left <= 0:
                i = bisect.bisect_left(self.lengths, n)
                n = next((m for m in reversed(self.lengths[:i]) if self.counts[m] > taken.get(m, 0)), None)
                if n is None:
                    return
                left = self.counts[n] - taken.get(n, 0)
            more = min(left, (room - used) // n)
            taken[n] = taken.get(n, 0) + more
            used += more * n
            at = min(n - 1, room - used)

    def take(self, taken: dict[int, int], most: int) -> int:
        """Remove as many of these sequences as the stock and ``most`` allow."""
        repeats = min(most, *(self.counts[n] // k for n, k in taken.items()))
        for n, k in taken.items():
            self.counts[n] -= k * repeats
            if not self.counts[n]:
                del self.counts[n]
                self.lengths.pop(bisect.bisect_left(self.lengths, n))
        return repeats


def pack_lengths(counts: dict[int, int], room: int = ROOM, grid: int = GRID, parts: int = MOST_PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences), using up ``counts`` exactly.

    Each entry uses up a length or a pattern, so there are at most as many entries as lengths
    and patterns, however large the counts are.
    """
    stock, packed = Stock(counts), []
    grid = min(grid, room)
    cell = room / grid
    shapes = list(patterns(grid, parts))
    held = np.zeros(grid + 1)
    for n, c in stock.counts.items():
        held[min(grid, max(1, round(n / cell)))] += c
    a = np.zeros((grid, len(shapes)))
    for j, shape in enumerate(shapes):
        for g in shape:
            a[g - 1, j] += 1
    weight = np.arange(1, grid + 1) / grid
    repeats = np.floor(non_negative_fit(a * weight[:, None], held[1:] * weight) + 0.5).astype(int)
    for j in sorted(np.flatnonzero(repeats), key=lambda j: shapes[j], reverse=True):
        left = int(repeats[j])
        while left > 0:
            taken, used = {}, 0
            for g in shapes[j][:-1] if len(shapes[j]) > 1 else shapes[j]:
                n = stock.largest(min(room - used, int((g + 0.5) * cell)), int(np.ceil((g - 0.5) * cell)))
                if n is None or stock.counts[n] <= taken.get(n, 0):
                    break
                taken[n], used = taken.get(n, 0) + 1, used + n
            else:
                stock.fill(taken, used, room)
                # What is short of a full sequence is left to the best fit over all that remains.
                if sum(n * k for n, k in taken.items()) >= room - max(1, room // 256):
                    done = stock.take(taken, left)
                    packed.append((taken, done))
                    left -= done
                    continue
            break
    while stock.lengths:
        taken: dict[int, int] = {}
        stock.fill(taken, 0, room)
        packed.append((taken, stock.take(taken, 1 << 62)))
    return [(tuple(n for n in sorted(taken, reverse=True) for _ in range(taken[n])), done) for taken, done in packed]


def pack(pieces: DataFrame, room: int = ROOM, grid: int = GRID, parts: int = MOST_PARTS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    Equal rows take different places. Ranks among equal lengths are counted in groups of about
    ``RANK_GROUP`` rows, so a length that a third of all pieces have is spread over many tasks.
    """
    pieces = shared(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    packed = pack_lengths(counts, room, grid, parts)
    keys, bases, starts, offsets = [], [], [], []
    next_rank, base = dict.fromkeys(counts, 0), 0
    for lengths, repeats in packed:
        at = 0
        for n in lengths:
            keys.append((n << 40) + next_rank[n])
            starts.append(next_rank[n])
            bases.append(base)
            offsets.append(at)
            next_rank[n] += repeats
            at += n
        base += repeats
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    places = pieces.sparkSession.sparkContext.broadcast(
        tuple(np.array(v, np.int64)[order] for v in (keys, bases, starts, offsets)))

    groups = max(1, sum(counts.values()) // RANK_GROUP)
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = (salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n"))
              .drop("_n"))
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (salted.withColumn("_row", F.row_number().over(within)).join(before, ["length", "_group"])
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1).select(*pieces.columns, "_rank"))

    columns = pieces.columns

    def place(batches):
        key, first, rank, offset = places.value
        for batch in batches:
            n, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(key, (n << 40) + own, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(first[at] + own - rank[at]), pa.array(offset[at])],
                names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, room: int = ROOM) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``room`` tokens.

    An empty table gives no rows; a null id keeps its rows; equal rows are packed each.
    """
    return pack(token_pieces(docs, vocabulary, room), room)
