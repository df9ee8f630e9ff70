"""The operators as named queries over the given tables, and the SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsight.llm import (
    chunk_bpe, collocations, cover_tree, doubling, learned_parts, merkle, order, packing, rlbwt, secrets, sharding, simhash, toxicity)
from netsight.llm.common import table
from netsight.llm.oracles import llm_sql

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts, and spans in code points."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_learned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every 20th vector."""
    return learned_parts.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


def op4_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer scores of every 50th vector."""
    return cover_tree.top_scores(table(spark, sf_dir, "embeddings"), 50, 5)


def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those at 4 bits or less."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents packed into sequences of 4096."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without 50-word windows that a smaller document has."""
    return doubling.dedup(table(spark, sf_dir, "documents"))


def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    return chunk_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 200-byte strings that occur twice or more."""
    return rlbwt.dedup(table(spark, sf_dir, "documents"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents in training order; returns where each document's ids are."""
    return order.training_order(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_veb_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and which of the tampered ones their proofs give away."""
    return merkle.tampering_found(table(spark, sf_dir, "documents"))


def op12_misra_gries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, and its shard if there were one more."""
    return sharding.placements(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity_cnn, op2_secret_automaton, op3_learned_parts, op4_dual_cover_tree, op5_simhash_gray, op6_best_fit_packing, op7_level_doubling,
        op8_chunk_bpe, op9_run_length_index, op10_training_order, op11_veb_merkle, op12_misra_gries, op13_rendezvous)}


def llm_oracles() -> dict[str, str]:
    """SQL for the same rows, where SQL can say them."""
    return llm_sql()
