"""Phrase collocations from mergeable Misra-Gries summaries and an exact second pass.

A Misra-Gries summary of capacity ``k`` over a mass ``m`` loses at most ``m / (k + 1)`` of any
count, also after merging. Phrases are dealt to hash partitions; each partition's summary gets a
capacity above its mass divided by the threshold, so every phrase that reaches the threshold is
still in it. What survives is a superset of the frequent phrases of a few entries for each
``threshold`` of mass; the second pass counts the survivors in the texts themselves, exactly.

Words and pairs come first. Three and four words are summarised only where all their pairs
survived, since a frequent phrase has frequent pairs. Survivors are told to the scans by a bit for
each hash, in a filter of ``FILTER_BITS`` bits whatever the corpus: where two hashes share a bit,
a scan passes more than it must and the exact counts drop it, so a full filter costs time alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsight.llm.common import SLICE_BYTES, mixed, shared, slices, span_hashes, text_bytes

THRESHOLD = 30
LONGEST = 4
PER_LANG = 2000
FILTER_BITS = 1 << 27
PART_MASS = 1 << 23
BUFFER = 1 << 22
_CHUNK_BITS = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False


class Words:
    """The words of a slice of texts: hashes, how many follow in the same piece, and their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        first, inside = first[:-1], _INSIDE[data]
        begins, ends = inside & first, inside.copy()
        begins[1:] |= inside[1:] & ~inside[:-1]
        ends[:-1] &= ~inside[1:] | first[1:]
        self.starts = np.flatnonzero(begins)
        self.lengths = np.flatnonzero(ends) + 1 - self.starts
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        pieces = np.cumsum(_BREAK[data])
        piece = pieces[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        joined = np.zeros(len(self.starts), bool)
        joined[:-1] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        #: How many of the next words belong to the same piece, LONGEST - 1 at most.
        self.after = np.zeros(len(joined), np.int8)
        reach = joined.copy()
        for step in range(1, LONGEST):
            self.after[reach] = step
            reach[:-step] &= joined[step:]
            reach[-step:] = False
        self.hashes = span_hashes(data, self.starts, self.lengths, inside)
        # The words with one space behind each: a phrase is a slice of it.
        width = self.lengths + 1
        self.places = np.cumsum(width) - width
        self.line = np.full(int(width.sum()), 0x20, np.uint8)
        keep = np.ones(len(self.line), bool)
        keep[self.places + self.lengths] = False
        self.line[keep] = data[inside]

    def phrases(self, n: int) -> np.ndarray:
        """First words of all phrases of ``n`` words."""
        return np.flatnonzero(self.after >= n - 1)

    def keys(self, first: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
        """A hash of each phrase of ``n`` words with its language."""
        h = lang[self.row[first]] ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for i in range(n):
            h = mixed((h + self.hashes[first + i]) * np.uint64(0x2545F4914F6CDD1D))
        return h

    def texts(self, first: np.ndarray, n: int) -> pa.Array:
        low = self.places[first]
        size = self.places[first + n - 1] + self.lengths[first + n - 1] - low
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], size)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.line[at]))


def bits(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys & np.uint64(size - 1)).astype(np.int64)


def has(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    at = bits(keys, 8 * len(filter_))
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums of counts (default: how often each occurs)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(new, len(keys))) if counts is None else np.add.reduceat(counts, new) if len(keys) else counts
    return keys[new], sums


class Summary:
    """A Misra-Gries summary; ``lost`` bounds what any count has lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Take in other counts, or the entries of another summary."""
        self.keys, self.counts = counted(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            stay = self.counts > cut
            self.keys, self.counts, self.lost = self.keys[stay], self.counts[stay] - cut, self.lost + cut

    def at_least(self, threshold: int) -> np.ndarray:
        """All keys that may have reached the threshold."""
        return self.keys[self.counts + self.lost >= threshold]


def _docs(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _cuts(data: np.ndarray, low: int, high: int) -> list[int]:
    """Where to cut a long text: behind breaks, about every ``SLICE_BYTES``. No phrase spans a break."""
    at = [low]
    while high - at[-1] > SLICE_BYTES:
        breaks, first = np.zeros(0, np.int64), at[-1] + SLICE_BYTES
        while not len(breaks) and first < high:
            breaks = np.flatnonzero(_BREAK[data[first:min(first + SLICE_BYTES, high)]])
            first += SLICE_BYTES
        at.append(int(first - SLICE_BYTES + breaks[0] + 1) if len(breaks) else high)
    return at if at[-1] == high else [*at, high]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words, np.ndarray]]:
    """(languages, words, keys of the languages) of slices of the texts; a long text is several slices."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        names, lang = batch.column("lang"), batch.column("lang_key").to_numpy().view(np.uint64)
        for low, high in slices(offsets):
            if high - low > 1 or offsets[high] - offsets[low] <= SLICE_BYTES:
                yield names.slice(low, high - low), Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]), lang[low:high]
                continue
            cuts = _cuts(data, int(offsets[low]), int(offsets[high]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield names.slice(low, 1), Words(data[a:b], np.array([0, b - a])), lang[low:high]


def _passing(words: Words, n: int, lang: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """First words of the phrases of ``n`` words whose pairs all have their bit set."""
    pair = np.zeros(len(words.starts), bool)
    first = words.phrases(2)
    pair[first] = has(passed, words.keys(first, 2, lang))
    found = words.phrases(n)
    for i in range(n - 1):
        found = found[pair[found + i]]
    return found


def _hashed(docs: DataFrame, lengths: tuple[int, ...], passed: Broadcast | None) -> DataFrame:
    """(key, c): hashes of the phrases of these lengths, counted within a task as far as its buffer goes."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, counts = counted(np.concatenate(held))
            return pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "c": pa.array(counts.astype(np.int32))})

        for _, words, lang in _scan(batches):
            for n in lengths:
                first = words.phrases(n) if passed is None else _passing(words, n, lang, np.frombuffer(passed.value, np.uint8))
                held.append(words.keys(first, n, lang))
                size += len(first)
            if size > BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "key long, c int")


def survivors(hashed: DataFrame, threshold: int, part_mass: int = PART_MASS) -> DataFrame:
    """(key) of every phrase that may reach the threshold; ``hashed`` (key, c) is a stored table.

    The number of hash partitions grows with the mass, so that a summary stays small.
    """
    mass = hashed.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    parts = max(1, -(-mass // part_mass))
    dealt = hashed.withColumn("part", F.pmod(F.shiftrightunsigned("key", 40), F.lit(parts)).cast("int"))
    capacity = dealt.groupBy("part").agg((F.floor(F.sum("c") / threshold) + 1).cast("long").alias("capacity"))

    def run(batches):
        found: dict[int, Summary] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def merge():
            part, key, c, capacity = (np.concatenate(x) for x in zip(*held, strict=True))
            for p in np.unique(part).tolist():
                own = part == p
                summary = found.setdefault(p, Summary(int(capacity[own][0])))
                summary.merge(key[own].view(np.uint64), c[own].astype(np.int64))

        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("part", "key", "c", "capacity")))
            size += batch.num_rows
            if size > BUFFER // 4:
                merge()
                held, size = [], 0
        if held:
            merge()
        for summary in found.values():
            yield pa.RecordBatch.from_pydict({"key": pa.array(summary.at_least(threshold).view(np.int64))})

    # The capacities are one row for each partition, which is one for each ``part_mass``.
    return dealt.repartition("part").join(capacity, "part").mapInArrow(run, "key long")


def filter_of(keys: DataFrame, size: int = FILTER_BITS) -> Broadcast:
    """A broadcast filter of ``size`` bits with the bit of every key set: size / 8 bytes, whatever the keys."""
    placed = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("bit"))

    def gather(table: pa.Table) -> pa.Table:
        chunk, made = table.column("chunk")[0], np.zeros(_CHUNK_BITS, np.uint8)
        made[table.column("bit").to_numpy() % _CHUNK_BITS] = 1
        return pa.table({"chunk": pa.array([chunk.as_py()]), "raw": pa.array([np.packbits(made, bitorder="little").tobytes()], pa.binary())})

    chunks = (placed.distinct().withColumn("chunk", F.shiftright("bit", _CHUNK_BITS.bit_length() - 1))
              .groupBy("chunk").applyInArrow(gather, "chunk long, raw binary"))
    whole = np.zeros(max(size, _CHUNK_BITS) // 8, np.uint8)
    for row in chunks.toLocalIterator():
        whole[row["chunk"] * _CHUNK_BITS // 8:][:_CHUNK_BITS // 8] = np.frombuffer(row["raw"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def _exact(docs: DataFrame, short: Broadcast, long: Broadcast) -> DataFrame:
    """(lang, k, phrase, c): the phrases that passed, as texts; k = 0 has a language's number of words."""

    def run(batches):
        for names, words, lang in _scan(batches):
            total = np.bincount(words.row, minlength=len(names))
            yield pa.RecordBatch.from_pydict({"lang": names, "k": pa.array(np.zeros(len(total), np.int32)),
                                              "phrase": pa.array([""] * len(total)), "c": pa.array(total.astype(np.int64))})
            for n in range(1, LONGEST + 1):
                filter_ = np.frombuffer((short if n < 3 else long).value, np.uint8)
                first = words.phrases(n) if n < 3 else _passing(words, n, lang, np.frombuffer(short.value, np.uint8))
                keys = words.keys(first, n, lang)
                passed = has(filter_, keys)
                first, keys = first[passed], keys[passed]
                # Equal hashes with another word hash at any place are told apart, so that no count mixes phrases.
                order = np.lexsort((*(words.hashes[first + i] for i in range(n)), keys))
                first, keys = first[order], keys[order]
                new = np.ones(len(first), bool)
                new[1:] = keys[1:] != keys[:-1]
                for i in range(n):
                    h = words.hashes[first + i]
                    new[1:] |= h[1:] != h[:-1]
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_pydict({
                    "lang": names.take(pa.array(words.row[first[at]])), "k": pa.array(np.full(len(at), n, np.int32)),
                    "phrase": words.texts(first[at], n), "c": pa.array(np.diff(np.append(at, len(first))).astype(np.int64))})

    return docs.mapInArrow(run, "lang string, k int, phrase string, c long")


def frequent(docs: DataFrame, threshold: int = THRESHOLD, filter_bits: int = FILTER_BITS, part_mass: int = PART_MASS) -> DataFrame:
    """(lang, k, phrase, f): exact counts of all phrases of up to four words with at least ``threshold``.

    Rows of k = 0 have the number of all words of a language in ``f``, however small.
    """
    docs = _docs(docs)
    short = filter_of(survivors(shared(_hashed(docs, (1, 2), None), "short"), threshold, part_mass), filter_bits)
    long = filter_of(survivors(shared(_hashed(docs, (3, 4), short), "long"), threshold, part_mass), filter_bits)
    counts = _exact(docs, short, long).groupBy("lang", "k", "phrase").agg(F.sum("c").alias("f"))
    return shared(counts.where((F.col("k") == 0) | (F.col("f") >= threshold)), "frequent")


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, per_lang: int = PER_LANG, filter_bits: int = FILTER_BITS,
                 part_mass: int = PART_MASS) -> DataFrame:
    """The ``per_lang`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``; null and empty texts have no words; equal rows count each; an empty
    table gives no rows. Ties of score go to the larger count, then to the phrase of smaller bytes.
    Scores and shares are integers of 38 digits. Counts are gathered while the query is built.
    """
    found = frequent(docs, threshold, filter_bits, part_mass)
    counts = found.where("k > 0").select("lang", "phrase", "f")
    phrases = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = (phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "a", "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("before"),
                    _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("behind")))
    side = lambda name, n: counts.select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(n))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    scored = (cuts.join(side("before", "l"), ["lang", "before"]).join(side("behind", "r"), ["lang", "behind"])
              .withColumn("score", F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * whole("a"), whole("l") + whole("r"))))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part(F.col("w"), i, n))))
    inside = (phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = (lowest.join(inside, ["lang", "phrase"], "left")
            .where(F.col("most").isNull() | (F.lit(100).cast("decimal(3,0)") * whole("most") < F.lit(80).cast("decimal(2,0)") * whole("a")))
            .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))

    # The best of each salted share first, so that no task sorts a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = 1 + found.count() // (50 * per_lang)
    top = lambda df, *by: (df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
                           .where(F.col("rank") <= per_lang))
    best = top(kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))), "lang", "share").drop("share", "rank")
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return top(best, "lang").join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
