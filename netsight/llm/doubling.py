"""Substring deduplication by level-wise doubling of repeated word windows.

The lengths halve from the window's own down to ``BASE`` words. At the lowest, every text shows
one gram for each stretch of windows (``zones``); only where that gram is met again do the texts
show grams of twice the length, and so on, until the windows themselves are left. At each level
the rows are those that the level before could not settle, so texts without repeats cost one
pass and a few rows.

At the last level before the windows, equal zones are one class, whose smallest document settles
all its copies. Only groups with several different zones show their windows, once for each class
and not for each copy. Equal texts are one text from the start: all but the smallest document
lose what windows cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import shared, text_bytes, window_hashes
from netsight.llm.zones import corpus_zones, keyed, runs, words_of, zones

WINDOW = 50
BASE = 13
_RESULT = "n_words long, n_removed long, kept_sha256 string"


def lengths(window: int, base: int = BASE) -> list[int]:
    """The gram lengths below the window's, each at most doubled by the next: 13, 25 for 50."""
    out = [window]
    while out[0] > base:
        out.insert(0, -(-out[0] // 2))
    return out[:-1] or [window]


def covered(flags: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Which words lie in a window that starts at a flagged place."""
    change = np.zeros(n_words + 1, np.int64)
    low, high = runs(flags)
    np.add.at(change, low, 1)
    np.add.at(change, high + window - 1, -1)
    return np.cumsum(change)[:-1] > 0


def next_level(texts: DataFrame, candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """Zones of longer grams within the windows that ``candidates`` (ka, kb, low, high) name."""
    lists = candidates.groupBy("ka", "kb").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            values, places = words_of(data, offsets)
            spans = batch.column("spans").to_pylist()
            for low in range(0, len(spans), 200):
                high = min(len(spans), low + 200)
                own, at = values[places[low]:places[high]], places[low:high + 1] - places[low]
                wanted = np.zeros(len(own) + 1, bool)
                for i in range(low, high):
                    for s in spans[i]:
                        wanted[at[i - low] + s["low"]:at[i - low] + s["high"] + 1] = True
                z = zones(own, at, window, gram, wanted)
                base, rows = at[z["row"]], z["row"] + low
                yield pa.RecordBatch.from_pydict({
                    "group": pa.array(z["group"]), "content": pa.array(z["content"]),
                    **{c: batch.column(c).take(pa.array(rows)) for c in ("ka", "kb", "least")},
                    "low": pa.array((z["low"] - base).astype(np.int32)), "high": pa.array((z["high"] - base).astype(np.int32))})

    return texts.join(lists, ["ka", "kb"]).select("ka", "kb", "least", "text", "spans").mapInArrow(
        run, "group long, content long, ka long, kb long, least long, low int, high int")


def smallest_by_window(texts: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """(group, content, smallest): for each window of a class the smallest document that has it."""
    wanted = classes.groupBy("ka", "kb").agg(F.collect_list(F.struct("group", "content", "low", "high", "least")).alias("zones"))

    def run(batches):
        for batch in batches:
            values, places = words_of(*text_bytes(batch.column("text")))
            for i, own in enumerate(batch.column("zones").to_pylist()):
                hashes = window_hashes(values[places[i]:places[i + 1]], window).view(np.int64)
                sizes = np.array([z["high"] - z["low"] + 1 for z in own])
                repeat = {c: pa.array(np.repeat(np.array([z[c] for z in own], np.int64), sizes)) for c in ("group", "content", "least")}
                yield pa.RecordBatch.from_pydict({
                    **repeat, "place": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
                    "hash": pa.array(np.concatenate([hashes[z["low"]:z["high"] + 1] for z in own]))})

    shown = shared(texts.join(wanted, ["ka", "kb"]).select("text", "zones").mapInArrow(
        run, "group long, content long, least long, place int, hash long"), "windows")
    lowest = shown.groupBy("hash").agg(F.min("least").alias("smallest"))
    return (shown.select("group", "content", "place", "hash").join(lowest, "hash").groupBy("group", "content")
            .agg(F.sort_array(F.collect_list(F.struct("place", "smallest"))).alias("places"))
            .select("group", "content", F.col("places.smallest").alias("smallest")))


def dedup(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the digest of the words that stay.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    doc_id. Null and short texts lose nothing. A row without a doc_id neither loses words nor
    makes others lose them; rows with one doc_id do not make each other lose words. An empty
    table gives no rows.
    """
    steps = lengths(window, base)
    texts = keyed(docs).groupBy("ka", "kb").agg(F.min("text").alias("text"), F.min("doc_id").alias("least"))
    level = shared(corpus_zones(docs, window, steps[0], words=True).select("group", "ka", "kb", "low", "high"), "level")
    for gram in steps[1:] or steps:
        level = shared(next_level(texts.where("least is not null"), level, window, gram), "level")
        again = level.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
        if gram != (steps[1:] or steps)[-1]:
            level = level.join(again, "group")
    classes = level.groupBy("group", "content").agg(
        F.min(F.struct("least", "ka", "kb", "low", "high")).alias("at"), F.count("*").alias("n"))
    kinds = classes.groupBy("group").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1").drop("total")
    classes = shared(classes.join(kinds, "group").select("group", "content", "at.*", "kinds"), "classes")
    several = smallest_by_window(texts, classes.where("kinds > 1"), window)
    alone = classes.where("kinds = 1").select("group", "content", F.array("least").alias("smallest"))
    found = (level.join(several.union(alone), ["group", "content"]).groupBy("ka", "kb")
             .agg(F.collect_list(F.struct("low", "high", "smallest")).alias("zones")))

    def run(batches):
        for batch in batches:
            raws, least, known = (batch.column(c).to_pylist() for c in ("text", "least", "zones"))
            out = []
            for raw, own, found_zones in zip(raws, least, known, strict=True):
                words = raw.encode().split()
                flags = np.zeros(max(0, len(words) - window + 1), bool)
                for z in found_zones or []:
                    flags[z["low"]:z["high"] + 1] |= np.array(z["smallest"], np.int64) < own
                gone = covered(flags, window, len(words))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("ka", "kb", "least")},
                **{c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("whole_sha256", pa.string())))}})

    made = texts.join(found, ["ka", "kb"], "left").mapInArrow(run, "ka long, kb long, least long, " + _RESULT + ", whole_sha256 string")
    own = keyed(docs).select("doc_id", "ka", "kb").join(made, ["ka", "kb"])
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window)
    whole = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least"))
    return own.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(whole, F.lit(0)).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(whole, F.col("whole_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
