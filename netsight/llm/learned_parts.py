"""Approximate nearest neighbours through learned partitions.

The neighbour graph of a bounded sample is split into balanced parts: centres are drawn, and each
vector in turn takes the part that most of its graph neighbours are in, as long as that part has
room. A small classifier (one hidden layer, softmax) then learns from the vector alone which
parts its neighbours lie in. Every row is put in its most probable part; a query goes to as many
of its most probable parts as the sample needed to find ``RECALL`` of its true neighbours, and
what these hold is ranked by the exact inner product.

The model is fitted on at most ``SAMPLE`` rows, those whose ids hash lowest; every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.blocks import cut, matrix, one_each, search, vectors

SAMPLE = 6000
PARTS = 16
NEIGHBOURS = 20
HIDDEN = 128
EPOCHS = 30
RECALL = 0.96
ROUNDS = 10


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the ``k`` others with the largest inner products."""
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 500):
        s = x[low:low + 500] @ x.T
        s[np.arange(len(s)), low + np.arange(len(s))] = -np.inf
        out[low:low + 500] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.05) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the graph."""
    n = len(graph)
    most = int(np.ceil(n / parts * slack))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.full(n, -1)
    sizes = np.zeros(parts, np.int64)
    for i in rng.permutation(n):
        likes = x[i] @ centres.T
        likes[sizes >= most] = -np.inf
        part[i] = int(np.argmax(likes))
        sizes[part[i]] += 1
    ends = np.repeat(np.arange(n), graph.shape[1])
    both = np.concatenate([ends, graph.ravel()]), np.concatenate([graph.ravel(), ends])
    order = np.argsort(both[0], kind="stable")
    near, edge = both[1][order], np.searchsorted(both[0][order], np.arange(n + 1))
    for _ in range(ROUNDS):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[near[edge[i]:edge[i + 1]]], minlength=parts).astype(float)
            votes[(sizes >= most) & (np.arange(parts) != part[i])] = -1
            to = int(np.argmax(votes))
            if votes[to] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 100:
            break
    return part


class Router:
    """Probable parts of a vector: a hidden layer and a softmax."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.w = [rng.standard_normal((dim, HIDDEN)) / np.sqrt(dim), np.zeros(HIDDEN),
                  rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        self.probes, self.scale = parts, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def learn(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """``target``: for each row the shares of its neighbours in the parts."""
        self.scale = 1 / max(1e-300, float(np.sqrt((x ** 2).mean())))
        m, v, step = [0 * w for w in self.w], [0 * w for w in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for low in range(0, len(x), 128):
                own = order[low:low + 128]
                a = x[own] * self.scale
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - target[own]) / len(own)
                back = (d @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((a.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.w[i] -= 0.002 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)


def fit(rows: DataFrame, parts: int = PARTS, sample: int = SAMPLE, recall: float = RECALL, seed: int = 5) -> Router | None:
    """Learn the parts from at most ``sample`` rows of (vec_id, v); None if there are too few."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    dims = {len(r["v"]) for r in found}
    if len(found) < 4 * NEIGHBOURS or len(dims) != 1:
        return None
    rng = np.random.default_rng(seed)
    x = np.array([r["v"] for r in found])
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, x, parts, rng)
    test = rng.permutation(len(x))[:max(1, len(x) // 6)]
    train = np.setdiff1d(np.arange(len(x)), test)
    shares = np.stack([np.bincount(p, minlength=parts) for p in part[graph]]) / graph.shape[1]
    router = Router(x.shape[1], parts, rng)
    router.learn(x[train], shares[train], rng)
    # The number of parts to probe: what queries kept from training need.
    z = router.logits(x)
    home = z.argmax(1)
    rank = np.argsort(np.argsort(-z[test], axis=1), axis=1)
    needed = np.take_along_axis(rank, home[graph[test]], axis=1)
    reached = [(needed < p).mean() for p in range(1, parts + 1)]
    router.probes = 1 + next(i for i, r in enumerate(reached) if r >= recall)
    return router


def nearest(rows: DataFrame, every: int, k: int, parts: int = PARTS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id ``every`` divides.

    ``rows`` has vec_id and embedding. Null and zero vectors and those with null or non-finite
    components take no part; nor do vectors of another length than their query's. Ties go to the
    smaller vec_id; a row is not its own neighbour; of rows with one vec_id
    one asks, and they are not each other's neighbours.
    An empty table gives no rows; tables too small to learn from are one part.
    """
    rows = vectors(rows, nonzero=True)
    router = fit(rows, parts, sample, recall)
    queries = one_each(rows.where(F.col("vec_id") % every == 0))
    length = F.size("v").cast("long")
    if router is None:
        rows, queries = (f.withColumn("part", length * parts) for f in (rows, queries))
    else:
        model, probes = rows.sparkSession.sparkContext.broadcast(router), router.probes

        def routed(batches, count):
            for batch in batches:
                size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
                model_dim = model.value.w[0].shape[0]
                part = np.zeros((len(size), count), np.int64)
                fits = np.flatnonzero(size == model_dim)
                if len(fits):
                    z = model.value.logits(matrix(batch.column("v").take(pa.array(fits))))
                    part[fits] = np.argsort(-z, axis=1, kind="stable")[:, :count]
                part += (size.astype(np.int64) * parts)[:, None]
                for p in range(count):
                    own = pa.array(fits if p else np.arange(len(size)))
                    yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").take(own), "v": batch.column("v").take(own), "part": pa.array(part[:, p]).take(own)})

        schema = "vec_id long, v array<double>, part long"
        rows = rows.mapInArrow(lambda b: routed(b, 1), schema)
        queries = queries.mapInArrow(lambda b: routed(b, probes), schema)

    def best(ids, q, others, x):
        out = []
        for low in range(0, len(q), 256):
            s = q[low:low + 256] @ x.T
            s[ids[low:low + 256, None] == others[None, :]] = -np.inf
            take = min(k, s.shape[1])
            # All that reach the kth best, so that ties are settled by id.
            bar = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
            slack = 1e-9 * (1 + np.abs(bar))
            a, b = np.nonzero((s >= (bar - slack)[:, None]) & (s > -np.inf))
            out.append(cut(a, b, exact(q[low:low + 256], a, x, b), others, k))
            out[-1] = (out[-1][0] + low, *out[-1][1:])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return search(queries, rows, k, best, "double")


def exact(q: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed in the same order whatever block they are in."""
    total = np.zeros(len(a))
    for i in range(q.shape[1]):
        total += q[a, i] * x[b, i]
    return total
