"""Encoding, packing and training order against the tokenizers library and exact round trips."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netsight.llm import chunk_bpe, order, packing
from netsight.llm.tokens import Encoder
from netsight.session import work_path

SF = "/root/testdata/sf0.001"
PATHS = {kind: public_tokenizers.path(name) for kind, name in (("bytes", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json"))}


def library(kind):
    return Tokenizer.from_file(PATHS[kind])


def bodies(*frames):
    return [r["text"] or "" for f in frames for r in f.select("text").collect()]


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_ids_are_those_of_the_library(spark, hard_docs, kind):
    found = bodies(hard_docs, spark.read.parquet(f"{SF}/documents.parquet"))
    raws = [t.encode() for t in found]
    small = Encoder(PATHS[kind], capacity=500)
    for codec in (Encoder(PATHS[kind]), small):
        ids, offs = codec.encode(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [
            e.ids for e in library(kind).encode_batch(found, add_special_tokens=False)]


@pytest.mark.parametrize("mean", [40, 1024])
def test_chunked_encoding_is_exact(spark, hard_docs, mean):
    docs = hard_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = Counter()
    lib = library("bytes")
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, chunk_bpe.digests(docs, PATHS["bytes"], mean).collect())) == want
    full = chunk_bpe.encode(hard_docs, PATHS["bytes"], mean).collect()
    assert all(bytes(r["decoded"]).decode() == lib.decode(np.frombuffer(r["ids"], "<u2").tolist(), skip_special_tokens=False) for r in full)


def test_joins_of_chunks_encoded_as_cut_are_repaired(hard_docs):
    store, lib, differ = chunk_bpe.Chunks(Encoder(PATHS["bytes"])), library("bytes"), 0
    found = [*bodies(hard_docs), "internationalisation of unseparated" * 40, "word  \n\n of " * 60, "\u00e9t\u00e9 \u65e5\u672c" * 80]
    raws = [t.encode() for t in found]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    made = store.encode(data, offsets, 16)
    for text, raw, low, (ids, decoded) in zip(found, raws, offsets.tolist(), made, strict=False):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u2").tolist() == want and decoded.decode() == lib.decode(want, skip_special_tokens=False)
        cuts = [0, *(store.cuts(data, offsets, 16) - low).tolist(), len(raw)]
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if 0 <= a < b <= len(raw)]
        differ += [i for c in store.coded(parts) for i in c.ids.tolist()] != want
    assert differ > 3


def test_empty_tables(no_docs):
    assert packing.pack_documents(no_docs, PATHS["words"]).count() == 0
    assert chunk_bpe.digests(no_docs, PATHS["bytes"]).count() == 0
    assert order.training_order(no_docs, PATHS["bytes"]).count() == 0


def test_pieces_fill_sequences_without_gaps(spark, hard_docs):
    docs = hard_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    lib, want = library("words"), Counter()
    for r in docs.collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[r["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack_documents(docs, PATHS["words"]).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 4096) + 1


@pytest.mark.parametrize("lengths", [[], [5], [4096] * 3, [3000] * 7, list(range(1, 4097, 7)) * 2])
def test_histogram_is_used_up(lengths):
    packed = packing.pack_lengths(dict(Counter(lengths)))
    used = Counter()
    for shape, repeats in packed:
        assert sum(shape) <= 4096 and repeats > 0
        for n in shape:
            used[n] += repeats
    assert used == Counter(lengths)


def test_non_negative_fit_meets_the_optimality_conditions():
    rng = np.random.default_rng(3)
    a, b = rng.random((12, 30)), rng.random(12) * 5
    x = packing.non_negative_fit(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_the_permutation_is_a_bijection_with_an_inverse(n):
    slots = order.permuted(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert order.permuted(slots, n, back=True).tolist() == list(range(n))


def test_shards_hold_the_stream_in_training_order(spark, hard_docs):
    docs = hard_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    length, shard_bytes, path = 64, 64 * 129, work_path(spark, "shards-test")
    index = order.write_in_order(docs, PATHS["bytes"], path, length=length, shard_bytes=shard_bytes).collect()
    lib, want = library("bytes"), Counter()
    for r in docs.collect():
        want[r["doc_id"], np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 50256], "<u2").tobytes()] += 1
    total = sum(len(ids) // 2 * n for (_, ids), n in want.items())
    n = -(-total // length)
    stored = order.read_slots(spark, path, 0, n + 5, length, shard_bytes)
    assert stored.shape == (n, length)
    resumed = order.read_slots(spark, path, 70, 130, length, shard_bytes)
    assert (resumed == stored[70:200]).all()
    stream = stored[order.permuted(np.arange(n), n)].ravel()
    assert (stream[total:] == 50256).all()
    at = {r["slot"]: i for i, r in enumerate(index)}
    assert set(at) == set(range(n))
    got, now = Counter(), {}
    for r in sorted(index, key=lambda r: (order.permuted(np.array([r["slot"]]), n, back=True)[0], r["offset"])):
        run = stored[r["slot"], r["offset"]:r["offset"] + r["length"]].tobytes()
        assert zlib.crc32(run) == r["ids_crc32"] and r["byte_offset"] == r["slot"] % 64 * 129 and r["shard"] == r["slot"] // 64
        now[r["doc_id"]] = run if r["start"] == 0 else now[r["doc_id"]] + run
        if now[r["doc_id"]].endswith(np.array([50256], "<u2").tobytes()) and (r["doc_id"], now[r["doc_id"]]) in want:
            got[r["doc_id"], now[r["doc_id"]]] += 1
    assert got == want
