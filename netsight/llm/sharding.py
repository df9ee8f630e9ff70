"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard bids for every key; the highest bid wins. A bid depends on the key and on that shard
alone, so a new shard takes only the keys for which it bids most, and no key moves between old
shards. With ``u`` uniform in (0, 1) from the hash of (key, shard), the bid is ``-weight / ln(u)``:
a shard wins in proportion to its weight.

The hash is 32-bit multiply-and-shift mixing in plain integer columns, which any SQL engine can
repeat. Everything is DataFrame functions; the cost of a row is one bid for each shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import shared
from netsight.llm.ranks import ranked

ROUNDS = 3
FACTOR = 0x45D9F3B  # below 2^31: its product with 32 bits fits a signed long
MASK = 0xFFFFFFFF
SHARDS = 24


def mixed32(h: Column) -> Column:
    """Spread 32 bits."""
    for _ in range(ROUNDS):
        h = (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(FACTOR)).bitwiseAND(F.lit(MASK))
    return h.bitwiseXOR(F.shiftright(h, 16))


def mixed32_of(n: int) -> int:
    """``mixed32`` of a number."""
    for _ in range(ROUNDS):
        n = ((n ^ (n >> 16)) * FACTOR) & MASK
    return n ^ (n >> 16)


def stable_key(*columns: Column) -> Column:
    """A record key as 64 bits: a long as it is, anything else by hash; null is a key like any other."""
    return F.xxhash64(*columns) if len(columns) > 1 else F.coalesce(columns[0], F.lit(-(1 << 63)))


def key_hash(key: Column) -> Column:
    """32 well-mixed bits of a 64-bit key."""
    low, high = key.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(key, 32)
    return mixed32(mixed32(low).bitwiseXOR(high))


def shard_of(hashed: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that wins the key; of equal bids the smallest shard's.

    ``weights`` has one positive number for each shard. A shard's seed comes from its number, so
    appending weights adds shards and changes no bid of the others.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    shards = F.array(*[F.struct(F.lit(-i).alias("turn"), F.lit(mixed32_of(i + 1)).cast("long").alias("seed"), F.lit(float(w)).alias("weight"))
                       for i, w in enumerate(weights)])

    def bid(s: Column) -> Column:
        u = (mixed32(hashed.bitwiseXOR(s["seed"])) + F.lit(0.5)) / F.lit(float(1 << 32))
        return F.struct((-s["weight"] / F.ln(u)).alias("bid"), s["turn"].alias("turn"))

    return (-F.array_max(F.transform(shards, bid))["turn"]).cast("int")


def sharded(docs: DataFrame, weights: Sequence[float], key: Column, shard: str = "shard") -> DataFrame:
    """``docs`` with the shard of every row; one narrow pass. Equal keys share a shard."""
    hashed = "_hash"
    while hashed in docs.columns:
        hashed += "_"
    return docs.withColumn(hashed, key_hash(key)).withColumn(shard, shard_of(F.col(hashed), weights)).drop(hashed)


def placements(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """Per document: size, text_crc32, law, shard, its slot there, and its shard if one of weight ``added`` came.

    Slots are gapless from 0 in each shard, in the order of doc_id (null first), then of the
    checksum and size; equal rows are rows each. A null text has no bytes: size 8, checksum 0. A
    null doc_id is one key. Other columns play no part. An empty table gives no rows. A shard has
    no task of its own: rows are dealt by ranges of (shard, doc_id), so one key may hold any share.
    The narrow rows are written to the shared folder while the query is built.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = sharded(rows, weights, stable_key(F.col("doc_id")))
    rows = sharded(rows, [*weights, added], stable_key(F.col("doc_id")), "grown_shard")
    placed = ranked(shared(rows, "shards"), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key: Column, files: int = 1) -> None:
    """Write ``docs`` under ``path/shard=N/``, ``files`` to a shard.

    Keys are dealt over the files of their shard by their hash, and a key of very many rows by its
    rows too, so that no task holds a shard or a hot key. The rows are read once and shuffled once.
    """
    if "shard" in docs.columns:
        raise ValueError("the rows have a column named shard already")
    rows = sharded(docs, weights, key)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files))
    (rows.repartition(len(weights) * files, F.col("shard"), salt).write.partitionBy("shard").parquet(path))

