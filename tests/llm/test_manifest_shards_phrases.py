"""Merkle manifest, rendezvous shards and phrase collocations against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsight.llm import collocations, merkle, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, hard_docs):
    """The hard documents, repeated rows of one source, and the table's documents of many."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    given = spark.read.parquet(f"{SF}/documents.parquet").select(columns)
    return hard_docs.select(columns).union(given).union(given.where("doc_id < 30").withColumn("source", F.lit("s")))


# -- Merkle ---------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [*(row[c] for c in ("doc_id", "source", "lang", "n_chars")), text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(root, for each leaf its siblings) of a tree of three."""
    paths, spot = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, at in enumerate(spot):
            run = range(at - at % 3, min(at - at % 3 + 3, len(nodes)))
            paths[own].append(("".join(nodes[i] for i in run if i < at), "".join(nodes[i] for i in run if i > at)))
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        spot = [at // 3 for at in spot]
    return nodes[0] if nodes else None, paths


def proofs_by_hand(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    root, tops = climb([made[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(trees[s], key=lambda x: x[:3]), made[s][1], strict=True):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            now = leaf_of(r, r["text"].replace("\n", "")) if even and r["text"] is not None else leaf
            for a, b in path + top:
                now = sha(a + now + b)
            out[r["doc_id"], leaf, made[s][0], root, sha("".join(a + b for a, b in path + top)), now, now == root] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_proofs_equal_those_by_hand(docs, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    found = Counter(map(tuple, merkle.tampering_found(docs).collect()))
    assert found == proofs_by_hand(docs.collect())
    assert {k[-1] for k in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 13])
def test_trees_of_every_height(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = spark.range(n).selectExpr("id AS doc_id", "'t\n' AS text", "NULL AS lang", "CAST(NULL AS STRING) AS source", "2L AS n_chars")
    assert Counter(map(tuple, merkle.tampering_found(rows).collect())) == proofs_by_hand(rows.collect())


def test_layout_is_a_permutation_split_at_half_height():
    for levels in range(1, 8):
        at = np.concatenate([merkle.address(levels, d, np.arange(3**d)) for d in range(levels)])
        assert sorted(at.tolist()) == list(range(merkle.size(levels)))
        if levels > 1:
            top = levels // 2
            below = [merkle.address(levels, d, np.arange(3**d))[:3**(d - top)] for d in range(top, levels)]
            # the first bottom subtree lies in one piece behind the top
            assert sorted(np.concatenate(below).tolist()) == list(range(merkle.size(top), merkle.size(top) + merkle.size(levels - top)))
    leaves = [sha(str(i)) for i in range(20)]
    rows = merkle.rows_of(merkle.build(leaves), len(leaves))
    assert rows[0] == leaves and rows[-1] == [climb(leaves)[0]]
    assert all(merkle.fold(leaves[i], *merkle.siblings(rows, i)) == rows[-1][0] for i in range(20))


# -- shards -----------------------------------------------------------------------------

def test_placements(docs):
    rows = [r.asDict() for r in sharding.placements(docs).collect()]
    given = docs.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (g["doc_id"], len((g["text"] or "").encode()) + 8, zlib.crc32((g["text"] or "").encode())) for g in given)
    slots, by_id = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
        assert r["grown_shard"] in (r["shard"], sharding.SHARDS) and r["law"] == "key"
        assert by_id.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
    for held in slots.values():
        assert sorted(s for s, _ in held) == list(range(len(held)))
        ids = [i for _, i in sorted(held)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_weights_and_growth(spark):
    rows = spark.range(30_000)
    weights = [1.0, 2.0, 0.5, 4.0]
    got = sharding.sharded(sharding.sharded(rows, weights, F.col("id")), [*weights, 2.5], F.col("id"), "grown").collect()
    shares = Counter(r["shard"] for r in got)
    assert all(abs(shares[i] / 30_000 - w / sum(weights)) < 0.02 for i, w in enumerate(weights))
    assert all(r["grown"] in (r["shard"], 4) for r in got)
    assert abs(sum(r["grown"] == 4 for r in got) / 30_000 - 0.25) < 0.02
    mix = spark.createDataFrame([(n,) for n in (0, 1, 77, 2**32 - 1)], "n long").select("n", sharding.mixed32(F.col("n")).alias("m")).collect()
    assert all(r["m"] == sharding.mixed32_of(r["n"]) for r in mix)
    for bad in ([], [1.0, 0.0]):
        with pytest.raises(ValueError, match="positive weight"):
            sharding.shard_of(F.col("id"), bad)


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    key = sharding.stable_key(F.col("doc_id"))
    sharding.write_shards(docs.withColumn("_hash", F.lit(1)), path, (1.0, 2.0, 1.0), key, files=2)
    back = spark.read.parquet(path)
    rows = lambda df: Counter(map(tuple, df.select("doc_id", "text", "source", "shard").collect()))
    assert rows(back) == rows(sharding.sharded(docs, (1.0, 2.0, 1.0), key))
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(back, path + "2", (1.0,), key)


# -- phrases ------------------------------------------------------------------------------

def phrases_by_hand(rows, threshold, per_lang):
    total, f = Counter(), defaultdict(Counter)
    for r in rows:
        lang, text = "und" if r["lang"] is None else r["lang"], re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]", piece) if w]
            total[lang] += len(words)
            for n in range(1, 5):
                f[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if a >= threshold and len(p) > 1}
        most = Counter()
        for p, a in good.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    most[p[i:i + n]] = max(most[p[i:i + n]], a)
        kept = []
        for p, a in good.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if 100 * most[p] < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:per_lang], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return Counter(out)


@pytest.mark.parametrize("threshold,per_lang,bits,mass", [(2, 2000, 1 << 16, 500), (3, 40, 1 << 22, 1 << 23), (30, 2000, 1 << 16, 2000)])
def test_collocations(spark, docs, threshold, per_lang, bits, mass):
    odd = [(None, "A b\tc  d.E f A B c d, e\x0bA b c d\x0ce; A  B  C  D! b c\x0e d?"), ("en", "İ K ſ Å ß İ K ſ Å ß\nİ K ſ Å ß"), ("und", "a b c d"), ("xx", " .,; "), ("", "a b a b a b")]
    more = spark.createDataFrame([(i, t, lang, None, 0) for i, (lang, t) in enumerate(odd * 3)], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.union(more)
    found = collocations.collocations(every, threshold, per_lang, bits, mass)
    assert Counter(map(tuple, found.collect())) == phrases_by_hand(every.collect(), threshold, per_lang)


def test_summaries_keep_what_is_frequent_after_merging():
    rng = np.random.default_rng(3)
    for _ in range(20):
        keys = np.minimum(rng.zipf(1.3, 4000), 10**6).astype(np.uint64)
        threshold = 25
        whole, parts = collocations.Summary(len(keys) // threshold + 1), []
        for part in np.array_split(keys, 7):
            parts.append(collocations.Summary(len(keys) // threshold + 1))
            for piece in np.array_split(part, 5):
                parts[-1].merge(*collocations.counted(piece))
        for p in parts:
            whole.merge(p.keys, p.counts)
            whole.lost += p.lost
        exact = Counter(keys.tolist())
        held = set(whole.at_least(threshold).tolist())
        assert {k for k, n in exact.items() if n >= threshold} <= held
        assert len(whole.keys) <= whole.capacity and whole.lost * (whole.capacity + 1) <= len(keys)


def test_long_texts_are_cut_behind_breaks(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    text = ("one two, three four five. " * 40 + "x" * 200 + " six seven!" + " y" * 60).encode()
    data = np.frombuffer(text, np.uint8)
    cuts = collocations._cuts(data, 0, len(data))
    assert cuts[0] == 0 and cuts[-1] == len(data) and len(cuts) > 5
    assert all(text[c - 1:c] in (b",", b".", b"!") for c in cuts[1:-1])


def test_empty_tables(no_docs):
    assert merkle.tampering_found(no_docs).count() == 0
    assert sharding.placements(no_docs).count() == 0
    assert collocations.collocations(no_docs).count() == 0
