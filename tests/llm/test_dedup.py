"""Near-duplicates and repeated passages against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netsight.llm import doubling, jaccard, rlbwt, simhash, zones
from netsight.llm.common import map_texts
from netsight.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, hard_docs):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words, 70))
    made = [(1000 + i, " ".join(rng.choice(words, 30)) + " " + passage + " " + " ".join(rng.choice(words, 30))) for i in range(40)]
    base = " ".join(rng.choice(words, 300)).split()
    for i in range(30):
        own = list(base)
        own[int(rng.integers(300))] = "changed"
        made.append((1100 + i, " ".join(own)))
    made += [(1200 + i, "same text " * 60) for i in range(25)] + [(1300, "ab " * 500), (1301, "abc" * 300 + "é" * 300)]
    extra = spark.createDataFrame(made, "doc_id long, text string")
    return hard_docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).union(extra)


def words_of(text):
    return (text or "").encode().split()


def slow_fingerprint(text):
    w = words_of((text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_components_of_near_fingerprints(docs):
    rows = docs.collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= 4) + i + 1:
            parent[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r["doc_id"])
    want = Counter((r["doc_id"], prints[i], min((d for d in least[find(i)] if d is not None), default=None)) for i, r in enumerate(rows))
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_large_buckets_are_dealt_to_cells(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = int(rng.integers(2**63))
    fps = np.array(sorted({base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3).tolist())) for _ in range(900)}), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    whole = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    monkeypatch.setattr(simhash, "SLAB", 100)
    assert {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()} == whole
    part = np.arange(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 4) + i + 1
        part = simhash.joined(part, np.full(len(j), i), j)
    assert len(set(whole.values())) + sum(int(x) not in whole for x in fps.view(np.int64)) == len(set(part.tolist()))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 151), 100)}


def test_one_document_of_each_group_stays(spark, docs):
    got = simhash.one_of_each(docs).collect()
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in got} == {r["component_id"] for r in found}


def test_one_row_of_each_group_stays(spark):
    rng = np.random.default_rng(9)
    long, other, third, fourth = (" ".join(f"w{n}" for n in rng.integers(0, 500, 120)) for _ in range(4))
    rows = [(1, long), (1, long), (2, long), (None, other), (None, other), (None, third), (5, third), (6, third), (7, fourth), (None, fourth)]
    made = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, ka long")
    one = simhash.one_of_each(made)
    want = Counter([(1, long), (None, other), (5, third), (7, fourth)])
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in rlbwt.cut_repeats(one).collect()) == want


def shingles_of(text):
    w = words_of((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("slab", [1 << 19, 700])
def test_pipeline_links_every_pair_of_similarity_four_fifths(spark, docs, monkeypatch, slab):
    monkeypatch.setattr(jaccard, "SLAB", slab)
    rng = np.random.default_rng(12)
    made = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in rng.integers(0, 10**6, 220)]
        for copy in range(6):
            own = list(base)
            for at in rng.integers(0, 220, int(rng.integers(1, 9))):
                own[at] = f"x{rng.integers(10**9)}"
            made.append((2000 + 10 * group + copy, " ".join(own)))
    rows = docs.union(spark.createDataFrame(made, "doc_id long, text string")).collect()
    both = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles_of(r["text"]) for r in rows]
    part, far = np.arange(len(rows)), 0
    prints = [slow_fingerprint(r["text"]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)):
                far += (prints[i] ^ prints[j]).bit_count() > 4
                part = simhash.joined(part, np.array([i]), np.array([j]))
    assert far > 50
    want = {}
    for r, p in zip(rows, part.tolist(), strict=True):
        want.setdefault(p, []).append(r["doc_id"])
    found = jaccard.near_duplicates(both).collect()
    got = {}
    for r in found:
        got.setdefault(r["part"], []).append(r["doc_id"])
    order = lambda groups: sorted(sorted((d is None, d or 0) for d in g) for g in groups.values())
    assert order(got) == order(want)
    assert jaccard.one_of_each(both).count() == len(want)


def test_the_pipeline_hashes_half_a_megabyte_at_a_time(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(jaccard, "map_texts", lambda *given: asked.append(given[4] if len(given) > 4 else None) or map_texts(*given))
    long = spark.range(0, 40, 1, 1).select("id", F.expr("repeat(concat('a', id, ' b '), 20000)").alias("text")).withColumnRenamed("id", "doc_id")
    assert jaccard.one_of_each(long).count() == 40
    assert len(asked) == 2 and all(size and size <= 512 << 10 for size in asked)
    sizes = map_texts(long, "text", "n long, bytes long", lambda rows, data, offsets: {"n": [rows.num_rows], "bytes": [len(data)]}, 300_000).collect()
    assert sum(r["n"] for r in sizes) == 40 and all(r["n"] == 1 or r["bytes"] <= 300_000 for r in sizes) and len(sizes) > 5


def test_empty_table_of_the_pipeline_stage(no_docs):
    assert jaccard.one_of_each(no_docs).count() == 0


def test_pairs_that_no_star_links_are_compared_in_their_cell():
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [base[:60], base[20:90], base[25:95], base[:62], base[40:]]
    links = jaccard.cross_links(np.arange(5), np.arange(5), sets)
    assert {frozenset(pair) for pair in links} == {frozenset((0, 3)), frozenset((1, 2))}


def repeated_bytes(raws, window):
    seen = Counter(raw[i:i + window] for raw in raws for i in range(len(raw) - window + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if seen[raw[i:i + window]] > 1:
                gone[i:i + window] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("window", "gram", "kinds"), [(200, 32, 1000), (60, 16, 1000), (60, 16, 3)])
def test_repeated_bytes_go(docs, monkeypatch, window, gram, kinds):
    monkeypatch.setattr(rlbwt, "KINDS", kinds)
    rows = docs.collect()
    raws = [(r["text"] or "").encode() for r in rows]
    want = Counter()
    for r, raw, gone in zip(rows, raws, repeated_bytes(raws, window), strict=True):
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        n_spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[r["doc_id"], len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rlbwt.dedup(docs, window, gram).collect())
    assert got == want


def test_cells_over_the_ends_of_a_common_passage_are_cut_into_windows(spark, monkeypatch):
    rng = np.random.default_rng(21)
    text = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = text(260)
    rows = [(i, text(300) + passage + text(300)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(rlbwt, "KINDS", 20)
    cut, indexed = [], []
    real, pieces = rlbwt.window_marks, rlbwt.crowded_routes
    monkeypatch.setattr(rlbwt, "window_marks", lambda p, w: cut.append(p) or real(p, w))
    monkeypatch.setattr(rlbwt, "crowded_routes", lambda p: indexed.append(p) or pieces(p))
    raws = [r[1].encode() for r in rows]
    want = {r[0]: int(gone.sum()) for r, gone in zip(rows, repeated_bytes(raws, 200), strict=True)}
    assert {r["doc_id"]: r["n_removed"] for r in rlbwt.dedup(docs).collect()} == want
    crowded = {r["route"] for r in cut[0].select("route").distinct().collect()}
    sizes = {r["route"]: (r["count"], r["kinds"]) for r in indexed[0].groupBy("route").agg(
        F.count("*").alias("count"), F.countDistinct("bytes").alias("kinds")).collect()}
    assert max(kinds for _, kinds in sizes.values()) > 20
    assert all((route in crowded) == (count > 20) for route, (count, _) in sizes.items())


def test_texts_without_their_repeats_are_whole_characters(docs):
    rows = {r["doc_id"]: r["text"] for r in rlbwt.cut_repeats(docs).collect()}
    assert 1200 not in rows
    passages = [rows[1000 + i] for i in range(40)]
    assert all(0 < len(p.split()) < 90 for p in passages)


@pytest.mark.parametrize("n", [2, 7, 60, 400])
def test_longest_matches_of_the_run_index(n):
    rng = np.random.default_rng(n)
    text = np.append(rng.integers(97, 99, n), 200).astype(np.uint8)
    raw, best = text.tobytes(), rlbwt.RunIndex(text).matches()

    def common(i, j):
        k = 0
        while max(i, j) + k < len(raw) and raw[i + k] == raw[j + k]:
            k += 1
        return k

    assert best.tolist() == [max(common(i, j) for j in range(n + 1) if j != i) for i in range(n + 1)]
    index = rlbwt.RunIndex(text)
    assert index.run_lengths.sum() == n + 1 and (np.diff(index.run_symbols) != 0).all()


def test_zones_part_the_windows_by_their_content():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 4, 900).astype(np.uint64)
    offsets = np.array([0, 10, 10, 400, 900])
    z = zones.zones(values, offsets, 40, 8)
    covered = [p for lo, hi in zip(z["low"], z["high"], strict=True) for p in range(lo, hi + 1)]
    assert covered == [p for a, b in zip(offsets, offsets[1:], strict=False) for p in range(a, b - 39)]
    places = defaultdict(set)
    for group, anchor, lo, hi in zip(z["group"], z["anchor"], z["low"], z["high"], strict=True):
        for p in range(lo, hi + 1):
            assert p <= anchor <= p + 32
            places[values[p:p + 40].tobytes()].add((group, anchor - p))
    assert all(len(v) == 1 for v in places.values())


@pytest.mark.parametrize(("window", "base"), [(50, 13), (12, 3), (5, 5)])
def test_repeated_word_windows_go(docs, window, base):
    rows = docs.collect()
    least = {}
    for r in rows:
        w = words_of(r["text"])
        if r["doc_id"] is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    want = Counter()
    for r in rows:
        w = words_of(r["text"])
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if r["doc_id"] is not None and least[tuple(w[i:i + window])] < r["doc_id"]:
                gone[i:i + window] = True
        want[r["doc_id"], len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in doubling.dedup(docs, window, base).collect())
    assert got == want


def test_empty_tables(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0
    assert rlbwt.dedup(no_docs).count() == 0
    assert rlbwt.cut_repeats(no_docs).count() == 0
    assert doubling.dedup(no_docs).count() == 0


def test_near_copies_are_proposed_by_their_simhash(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = [(i, " ".join([*base[:399], f"last{i}"])) for i in range(6)]
    rows += [(100 + i, " ".join(f"x{j}" for j in rng.integers(0, 5000, 400))) for i in range(20)] + [(200, ""), (201, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = jaccard.signatures(docs).collect()
    sets = {r["doc_id"]: jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
            for r in prints for t in [dict(rows)[r["doc_id"]]]}
    for r in prints:
        own = [int(h) for h in sets[r["doc_id"]]]
        assert r["fp"] % 2**64 == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in own) * 2 > len(own))
    nodes = spark.createDataFrame([(r["node"], r["fp"]) for r in prints if r["n"]] + [(-7, prints[0]["fp"])], "node long, fp long")
    pairs = {(r["a"], r["b"]) for r in jaccard.gray_pairs(nodes).collect()}
    near = {r["node"] for r in prints if r["doc_id"] < 6} | {-7}
    together = components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    assert {n for p in pairs for n in p} == near and len({r["root"] for r in together}) == 1
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == [0, *range(100, 120), 200, 201]
