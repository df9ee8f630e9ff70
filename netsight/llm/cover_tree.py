"""Exact top-k by inner product with two cover trees.

The rows of a block and the queries of a block are each put in a cover tree: a node's centre is
one of its points, every point of a node lies within its radius, and the radii halve from level
to level. Both trees go down together. A pair of nodes holds no score above ``q.r + |q| rr +
|r| rq + rq rr`` (centres q and r, radii rq and rr), so the pair is left out, with all pairs
below it, once each query in the group has k scores at least as good. Pairs of leaves are scored
in integers.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.blocks import one_each, search, vectors

LEAF = 128
CHILDREN = 32
WHOLE = 2.0 ** 52  # doubles from here on are whole numbers


class Node:
    __slots__ = ("centre", "children", "norm", "points", "radius")

    def __init__(self, points: np.ndarray, centre: np.ndarray, radius: float):
        self.points, self.centre, self.radius = points, centre, radius
        self.norm, self.children = float(np.sqrt(centre @ centre)), []


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree over all rows of ``x``; equal points share a leaf, whatever their number."""

    def build(points: np.ndarray, centre: int, reach: np.ndarray) -> Node:
        node = Node(points, x[centre], float(reach.max(initial=0.0)))
        if len(points) <= leaf or node.radius == 0.0:
            return node
        # Points within half the radius stay with the centre; the farthest one left opens the next.
        half, near, owner = node.radius / 2, reach.copy(), np.zeros(len(points), np.int64)
        centres = [centre]
        while near.max() > half and len(centres) < len(points):
            centres.append(int(points[int(np.argmax(near))]))
            d = np.sqrt(((x[points] - x[centres[-1]]) ** 2).sum(1))
            closer = d < near
            owner[closer], near[closer] = len(centres) - 1, d[closer]
            if len(centres) >= CHILDREN:
                break
        for i, c in enumerate(centres):
            own = owner == i
            if own.any() and own.sum() < len(points):
                node.children.append(build(points[own], c, near[own]))
        return node

    if not len(x):
        return Node(np.zeros(0, np.int64), np.zeros(x.shape[1]), 0.0)
    first = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    return build(np.arange(len(x)), first, np.sqrt(((x - x[first]) ** 2).sum(1)))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs. Sums that a double cannot hold are made in whole
    numbers of any length; beyond a long, a score is the nearest long."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    made = big(a) @ big(b).T
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, s)) for s in row] for row in made], np.int64).reshape(len(a), len(b))


def best_pairs(ids: np.ndarray, q: np.ndarray, others: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, score) of each query's ``k`` best rows, others than its own id."""
    left, right = cover_tree(q), cover_tree(x)
    worst = np.full(len(q), -np.inf)
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    tick = 0

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * (1 + abs(top) + a.norm * b.norm)

    heap = [(-bound(left, right), tick, left, right)] if len(q) and len(x) else []
    while heap:
        top, _, a, b = heapq.heappop(heap)
        if -top < worst[a.points].min():
            continue
        if not a.children and not b.children:
            s = scores(q[a.points], x[b.points])
            hits = (s >= worst[a.points][:, None]) & (ids[a.points][:, None] != others[b.points][None, :])
            for i in np.flatnonzero(hits.any(1)).tolist():
                query, own = int(a.points[i]), np.flatnonzero(hits[i])
                places, values = np.concatenate([kept[query][0], b.points[own]]), np.concatenate([kept[query][1], s[i][own]])
                order = np.lexsort((others[places], np.invert(values)))[:k]
                kept[query] = places[order], values[order]
                if len(order) == k:
                    worst[query] = float(values[order[-1]])
            continue
        split_left = bool(a.children) and (not b.children or a.radius >= b.radius)
        for one in a.children if split_left else b.children:
            pair = (one, b) if split_left else (a, one)
            t = bound(*pair)
            if t >= worst[pair[0].points].min():
                tick += 1
                heapq.heappush(heap, (-t, tick, *pair))
    found = [(np.full(len(p), i), p, v) for i, (p, v) in enumerate(kept)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def top_scores(rows: DataFrame, every: int, k: int, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of each row whose id ``every`` divides.

    Components count as floor(scale * x). Null vectors and those with null or non-finite
    components take no part; zero vectors do; vectors meet those of their own length. Ties go to
    the smaller vec_id; of rows with one vec_id one asks, and they do not find each other. A score beyond the
    range of a long is the nearest long. An empty table gives no rows.
    """
    whole = lambda x: F.when(F.abs(x * scale) < WHOLE, F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = vectors(rows, nonzero=False).select("vec_id", F.transform("v", whole).alias("v"))
    rows = rows.withColumn("part", F.size("v").cast("long"))

    def best(ids, q, others, x):
        return best_pairs(ids, q, others, x, k)

    queries = one_each(rows.where(F.col("vec_id") % every == 0)).withColumn("part", F.size("v").cast("long"))
    return search(queries, rows, k, best, "long")
