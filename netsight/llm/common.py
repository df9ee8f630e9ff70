"""Helpers the operators share: inputs, shared tables, Arrow text buffers and rolling hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.session import written_once

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever other columns there are; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the cluster's shared folder: computed once, and safe from lost executors."""
    return written_once(df, f"llm-{name}")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Tables written within it pass their rows to Python in Arrow batches of this many at most.

    A batch is held by the JVM and by the worker, in each task; rows of whole sets make large ones.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    for i, name in enumerate(out := list(names)):
        while out[i].lower() in taken:
            out[i] += "_"
        taken.add(out[i].lower())
    return out


def text_key(text: Column | str) -> Column:
    """128 bits that stand for a text, for grouping equal ones."""
    text = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high
        low = high


def map_texts(df: DataFrame, column: str, schema: str,
              work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | dict | None], size: int = SLICE_BYTES) -> DataFrame:
    """Run ``work(rows, bytes, offsets)`` over slices of the partitions of about ``size`` bytes, in Arrow batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(column))
            for low, high in slices(offsets, size):
                made = work(batch.slice(low, high - low), data[offsets[low]:offsets[high]],
                            offsets[low:high + 1] - offsets[low])
                if made is not None:
                    yield pa.RecordBatch.from_pydict(made) if isinstance(made, dict) else made

    return df.mapInArrow(run, schema)


def map_documents(docs: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray | None, list | None]]) -> DataFrame:
    """Run ``work(rows, bytes, offsets)`` over slices; it says which rows stay and their new texts.

    All columns are kept as they are, but for ``text`` and the length in ``n_chars`` where there
    is one; a null text that is not replaced stays null.
    """
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text").fill_null(""))
            for low, high in slices(offsets):
                rows = batch.slice(low, high - low)
                keep, new = work(rows, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                if new is not None:
                    old = rows.column("text").to_pylist()
                    new = [o if n is None else n for o, n in zip(old, new, strict=True)]
                    for name, values in (("text", new), ("n_chars", [None if n is None else len(n) for n in new])):
                        if name in rows.schema.names:
                            at = rows.schema.get_field_index(name)
                            rows = rows.set_column(at, rows.schema.field(at).name, pa.array(values, rows.schema.field(at).type))
                yield rows if keep is None else rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, in place."""
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    h ^= h >> np.uint64(32)
    return h


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2^64, and those of its inverse."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.clear()
        _powers[size] = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
            for b in (_BASE, inverse))
    up, down = _powers[size]
    return up[:n], down[:n]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` values (uint64), as a prefix sum modulo 2^64."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down, out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * up[:n])


def window_lows(values: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` values, the place of its first smallest one."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, done = values, np.arange(len(values), dtype=np.int32), 1
    while done < span:
        step = min(done, span - done)
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.where(later, low[step:], low[:-step])
        done += step
    return at[:n]


_LONG = 512
_FACTORS = odd_numbers(_LONG + 1, 7)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of a slice's texts, and which bytes belong to one.

    A word is a run of bytes other than ASCII white space; none reaches past its text.
    """
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first, inside = first[:-1], ~SPACE[data]
    begins, ends = inside & first, inside.copy()
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, inside


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; bytes that are not ``inside`` count for nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    np.minimum(place, _LONG, out=place)
    terms = _FACTORS[place] * (data[starts[0]:].astype(np.uint64) + np.uint64(1))
    terms[~inside[starts[0]:]] = 0
    h = mixed(np.add.reduceat(terms, starts - starts[0]) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i] + lengths[i]].tobytes())
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, where each text's words begin)."""
    starts, lengths, inside = word_spans(data, offsets)
    return span_hashes(data, starts, lengths, inside), np.searchsorted(starts, offsets)
