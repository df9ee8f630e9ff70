"""Training-order materialisation of token ids in binary shards.

Texts are encoded once and laid one after the other, each with an end id behind it; every
``length`` ids are a sequence (the last is filled up with the end id). A keyed Feistel
permutation with cycle-walking gives sequence i a global slot; slots are dealt to shards in
ranges, and every shard is a file of fixed-stride records in the order of the slots. So a reader
finds slot s at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``, reads on
sequentially, and resumes from a slot number alone.

A record is ``length`` little-endian 16-bit ids and one line feed. Files go through Spark's text
writer, whose commit drops what lost or repeated tasks wrote, and which reaches any file system.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsight.llm.common import mixed, shared, slices, text_bytes, texts
from netsight.llm.tokens import encoder
from netsight.session import work_path

LENGTH = 2048
SHARD_BYTES = 32 << 20
ROUNDS = 6
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 15, 1 << 16
LEVEL = 6
KEY = 20_240_229


def permuted(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slots (``back``: the sequences) of numbers below ``n``: a bijection on range(n)."""
    half = np.uint64(max(1, math.ceil(max(1, (n - 1).bit_length()) / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key & (2**64 - 1)))
    out, left = index.astype(np.uint64), np.arange(len(index))
    while len(left):
        high, low = out[left] >> half, out[left] & mask
        for k in reversed(keys) if back else keys:
            if back:
                high, low = low ^ (mixed(high + k) & mask), high
            else:
                high, low = low, high ^ (mixed(low + k) & mask)
        out[left] = (high << half) | low
        left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def presser(shapes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(shapes.value))


def unpresser(shapes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shapes.value))


def dictionary(docs: DataFrame, vocabulary: str) -> zstandard.ZstdCompressionDict:
    """What short runs of ids have in common, from ``SAMPLE_TEXTS`` texts of at most
    ``SAMPLE_BYTES`` bytes each; it bears on the size of intermediate data alone."""
    rows = texts(docs).where(F.octet_length("text").between(200, SAMPLE_BYTES)).limit(SAMPLE_TEXTS).select("text").collect()
    raws = [r["text"].encode() for r in rows]
    ids, offs = encoder(vocabulary).encode(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    runs = [ids[a:b].astype("<u2").tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, runs)
    except zstandard.ZstdError:  # too few texts to learn from
        return zstandard.ZstdCompressionDict(b"")


def encoded(docs: DataFrame, vocabulary: str, end_id: int, shapes) -> DataFrame:
    """(doc_id, part, start, n, ids): ids behind one another within each part of the input."""

    def run(batches):
        part, start, press = TaskContext.get().partitionId(), 0, presser(shapes)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in slices(offsets):
                ids, offs = encoder(vocabulary).encode(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                counts = np.diff(offs) + 1
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                packed = [press.compress(np.append(ids[a:b], np.uint16(end_id)).astype("<u2").tobytes())
                          for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(low, high - low), "part": pa.array(np.full(len(packed), part, np.int32)),
                    "start": pa.array(starts), "n": pa.array(counts), "ids": pa.array(packed, pa.binary())})

    return texts(docs).mapInArrow(run, "doc_id long, part int, start long, n long, ids binary")


def write_in_order(docs: DataFrame, vocabulary: str, path: str, length: int = LENGTH, end_id: int = 50256,
                   key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards below ``path`` and return where each text's ids went.

    Rows: doc_id, start (the run's first id within the text), length, slot, offset (within the
    sequence), shard, byte_offset, ids_crc32 (of the run, little-endian 16-bit). Null and empty
    texts hold the end id alone; equal rows are written each; an empty table writes no shard.
    """
    spark = docs.sparkSession
    shapes = spark.sparkContext.broadcast(dictionary(docs, vocabulary).as_bytes())
    table = shared(encoded(docs, vocabulary, end_id, shapes), "encoded")
    # One row per part of the input; their running sum is the only work in a single task.
    parts = table.groupBy("part").agg(F.sum("n").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    n = -(-total // length)
    stride = 2 * length + 1
    per_shard = max(1, shard_bytes // stride)

    def cut(batches):
        unpress, press = unpresser(shapes), presser(shapes)
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")]
            docs_, starts, sequences, offsets, sizes, runs, sums = [], [], [], [], [], [], []
            for doc_id, at, size, ids in zip(*rows, strict=True):
                ids, done = unpress.decompress(ids), 0
                while done < size:
                    sequence, offset = divmod(at + done, length)
                    more = min(length - offset, size - done)
                    run = ids[2 * done:2 * (done + more)]
                    for values, value in zip((docs_, starts, sequences, offsets, sizes, runs, sums), (doc_id, done, sequence, offset, more, press.compress(run), zlib.crc32(run)), strict=True):
                        values.append(value)
                    done += more
            slot = permuted(np.array(sequences, np.int64), n, key)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs_, pa.int64()), "start": pa.array(starts, pa.int64()), "length": pa.array(sizes, pa.int64()),
                "slot": pa.array(slot), "offset": pa.array(offsets, pa.int64()), "shard": pa.array(slot // per_shard, pa.int32()),
                "ids_crc32": pa.array(sums, pa.int64()), "ids": pa.array(runs, pa.binary())})

    placed = (table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
              .mapInArrow(cut, "doc_id long, start long, length long, slot long, offset long, shard int, ids_crc32 long, ids binary"))
    runs = (placed.repartitionById(max(1, -(-n // per_shard)), F.col("shard")).sortWithinPartitions("slot", "offset"))
    fill = np.array([end_id], "<u2").tobytes()

    def assemble(batches):
        unpress = unpresser(shapes)
        now, record = None, bytearray()
        for batch in batches:
            records = []
            for slot, ids in zip(batch.column("slot").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if slot != now:
                    if now is not None:
                        records.append(bytes(record) + fill * (length - len(record) // 2))
                    now, record = slot, bytearray()
                record += unpress.decompress(ids)
            yield pa.RecordBatch.from_pydict({"record": pa.array(records, pa.binary())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"record": pa.array([bytes(record) + fill * (length - len(record) // 2)], pa.binary())})

    (runs.select("slot", "offset", "ids").mapInArrow(assemble, "record binary")
     .select(F.col("record").cast("string").alias("value")).write.text(path, lineSep="\n"))
    return (placed.drop("ids").withColumn("byte_offset", F.pmod("slot", F.lit(per_shard)) * stride))


def read_slots(spark: SparkSession, path: str, first: int, count: int, length: int = LENGTH,
               shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """``count`` sequences from slot ``first`` on, as a (count, length) array; for a resumed reader.

    Opens the files of the wanted shards alone and reads on from the slot's place in each.
    """
    stride = 2 * length + 1
    per_shard = max(1, shard_bytes // stride)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    while count > 0:
        # Spark pads the number to five digits, and writes larger ones whole.
        named = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"part-{first // per_shard:05d}-*"))
        if not len(named):
            break
        at, file = first % per_shard, named[0].getPath()
        size = min(count, system.getFileStatus(file).getLen() // stride - at, per_shard - at)
        if size <= 0:
            break
        stream = system.open(file)
        try:
            stream.seek(at * stride)
            raw = bytes(stream.readNBytes(size * stride))
        finally:
            stream.close()
        out.append(np.frombuffer(raw, np.uint8).reshape(size, stride)[:, :-1].copy().view("<u2"))
        first, count = first + size, count - size
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")


def training_order(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """``write_in_order`` into a new folder of the cluster's shared one."""
    return write_in_order(docs, vocabulary, work_path(docs.sparkSession, "llm-shards"), **options)
