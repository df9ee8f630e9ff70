"""Content-defined zones: which windows of a text go to which group, without looking elsewhere.

Every window of ``window`` values holds ``window - gram + 1`` grams; the first of those with the
smallest hash is its anchor. Equal windows have equal anchors at equal places, so windows that
repeat anywhere in the corpus meet in the group of their anchor. Consecutive windows with one
anchor form a zone; zones part a text's windows, with about two zones for each window's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsight.llm.common import mixed, powers, slices, text_bytes, texts, window_hashes, window_lows, word_hashes

PART = 1 << 20
SEEN = 1 << 18
_ZONE = "group long, content long, ka long, kb long, low int, high int, anchor int, n long"


def zones(values: np.ndarray, offsets: np.ndarray, window: int, gram: int, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The zones of texts that lie one after the other (``values`` as uint64), within ``wanted``.

    ``row``; ``low`` and ``high``, the first and last window start, as places in ``values``;
    ``anchor``, its place; ``group``, the anchor gram's hash; ``content``, the zone's own hash.
    """
    lows = window_lows(grams := window_hashes(values, gram), window - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(lows)]
    valid = np.arange(len(lows)) + window <= offsets[row + 1]
    starts = np.flatnonzero(valid if wanted is None else valid & wanted[:len(valid)])
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return {"row": empty, "low": empty, "high": empty, "anchor": empty, "group": empty, "content": empty}
    anchor = lows[starts].astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(row[starts], prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    low, high = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    return {"row": row[low], "low": low, "high": high, "anchor": anchor[new],
            "group": grams[anchor[new]].view(np.int64), "content": run_hashes(values, low, high + window).view(np.int64)}


def run_hashes(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[low:high]``."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down, out=sums[1:])
    return mixed((sums[high] - sums[low]) * up[low] + (high - low).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a batch's texts, slice by slice."""
    made, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for low, high in slices(offsets, PART // 4):
        h, places = word_hashes(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        made.append(h)
        ends.append(places[1:] + ends[-1][-1])
    return np.concatenate(made), np.concatenate(ends)


def keyed(docs: DataFrame) -> DataFrame:
    """Texts with 128 bits that stand for them."""
    return texts(docs).select("doc_id", "text", F.xxhash64("text").alias("ka"),
                              F.xxhash64(F.lit(1), F.col("text"), F.octet_length("text")).alias("kb"))


def corpus_zones(docs: DataFrame, window: int, gram: int, words: bool = False) -> DataFrame:
    """The zones that may repeat, one row for each text and place, with the number of copies.

    Windows and grams are runs of bytes, or of words. Places count bytes or words.

    A task knows some groups to be repeated from what it has read itself; their rows need no
    count, so they are spread evenly, and one row in all tells the other tasks of the group.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            if words:
                data, offsets = words_of(data, offsets)
            ka, kb = (batch.column(c).to_numpy() for c in ("ka", "kb"))
            _, first, times = np.unique(np.rec.fromarrays([ka, kb]), return_index=True, return_counts=True)
            where, spans = [], []
            for doc, n in zip(first.tolist(), times.tolist(), strict=True):
                a, b = int(offsets[doc]), int(offsets[doc + 1])
                for low in range(a, max(a + 1, b - window + 1), PART):
                    if min(b, low + PART + window - 1) - low >= window:
                        where.append((doc, n, low - a))
                        spans.append((low, min(b, low + PART + window - 1)))
            at = 0
            while at < len(spans):
                size, upto = 0, at
                while upto < len(spans) and (upto == at or size + spans[upto][1] - spans[upto][0] <= PART // 4):
                    size += spans[upto][1] - spans[upto][0]
                    upto += 1
                values = np.concatenate([data[a:b] for a, b in spans[at:upto]])
                values = values if words else values.astype(np.uint64) + np.uint64(1)
                places = np.concatenate([[0], np.cumsum([b - a for a, b in spans[at:upto]])])
                z = zones(values, places, window, gram)
                own = np.array(where[at:upto], np.int64).reshape(-1, 3)[z["row"]]
                base = own[:, 2] - places[z["row"]]
                group, n = z["group"], own[:, 1]
                kinds, kind, count = np.unique(group, return_inverse=True, return_counts=True)
                many = np.bincount(kind, weights=n, minlength=len(kinds)) > 1
                known = np.fromiter((g in seen for g in kinds.tolist()), bool, len(kinds))
                sure = (many | known)[kind]
                teller = np.zeros(len(group), bool)
                teller[np.unique(kind, return_index=True)[1][many & ~known]] = True
                if len(seen) < SEEN:
                    seen.update(kinds[many & ~known].tolist())
                yield pa.RecordBatch.from_pydict({
                    "group": pa.array(group), "content": pa.array(z["content"]), "ka": pa.array(ka[own[:, 0]]), "kb": pa.array(kb[own[:, 0]]),
                    "low": pa.array((z["low"] + base).astype(np.int32)), "high": pa.array((z["high"] + base).astype(np.int32)),
                    "anchor": pa.array((z["anchor"] + base).astype(np.int32)), "n": pa.array(n),
                    "sure": pa.array(sure), "teller": pa.array(teller | ~sure)})
                at = upto

    rows = keyed(docs).select("text", "ka", "kb").mapInArrow(run, _ZONE + ", sure boolean, teller boolean")
    dealt = rows.withColumn("deal", F.when(F.col("teller"), F.col("group")).otherwise(F.xxhash64("ka", "low", "group")))
    total = F.sum("n").over(Window.partitionBy("deal", "teller"))
    rest = F.max("sure").over(Window.partitionBy("deal", "teller"))
    return (dealt.withColumn("total", total).withColumn("rest", rest)
            .where(F.col("sure") | (F.col("total") > 1) | F.col("rest"))
            .groupBy("group", "content", "ka", "kb", "low", "high", "anchor").agg(F.sum("n").alias("n")))
