"""Queries against all rows in blocks: how both searches spread and merge their work."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024


def vectors(rows: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components; ``nonzero``: not all zero."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    keep = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad
    if nonzero:
        keep = keep & F.exists(v, lambda x: x != 0)
    return rows.where(keep).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def in_blocks(rows: DataFrame, key: Column, size: int, name: str) -> DataFrame:
    """Deal rows of each ``key`` to blocks of about ``size`` rows: adds ``name`` and ``name_count``.

    Keys are the learned parts or one constant, so the table of counts is small at any size.
    """
    keyed = rows.withColumn("part", key)
    counts = keyed.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}_count"))
    dealt = keyed.join(F.broadcast(counts), "part")
    return dealt.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.col(f"{name}_count")).cast("int"))


def search(queries: DataFrame, rows: DataFrame, k: int,
           best: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
           score: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best rows of the same ``part``s.

    ``queries`` and ``rows`` have part, vec_id, v. Every block of queries meets every block of
    rows of its part in a task of its own, where ``best(query ids, query vectors, row ids, row
    vectors)`` gives (query place, row place, score) of at most ``k`` rows a query; these are
    merged by score and then by the smaller id. A crowded part has more blocks, not larger tasks.
    Rows equal in id and vector are one row with a count before they are dealt; each of them is a
    candidate, and ``k`` of them are enough.
    """
    rows = rows.groupBy("part", "vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    rows = in_blocks(rows, F.col("part"), BLOCK_ROWS, "block")
    queries = in_blocks(queries, F.col("part"), BLOCK_QUERIES, "cell")
    row_blocks = rows.select("part", "block_count").distinct()
    query_blocks = queries.select("part", "cell_count").distinct()
    # One row for each part on either side: the number of its blocks.
    asked = (queries.join(F.broadcast(row_blocks), "part")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block_count") - 1))).select("part", "cell", "block", "vec_id", "v"))
    offered = (rows.join(F.broadcast(query_blocks), "part")
               .withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cell_count") - 1))).select("part", "cell", "block", "vec_id", "v", "n"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            q = r = np.zeros(0, np.int64)
            value = np.zeros(0)
            ids, others = q, r
        else:
            ids, others, x = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), matrix(right.column("v"))
            times = right.column("n").to_numpy()
            others, x = np.repeat(others, times), np.repeat(x, times, axis=0)
            # A query's own id takes k of the places at most, so as many others are left.
            first = first_copies(others, x, 2 * k)
            others, x = others[first], x[first]
            q, r, value = best(ids, matrix(left.column("v")), others, x)
        return pa.table({"query_id": pa.array(ids[q], pa.int64()), "vec_id": pa.array(others[r], pa.int64()),
                         "score": pa.array(value, pa.int64() if score == "long" else pa.float64())})

    cells = ["part", "cell", "block"]
    fresh = [F.col(c).alias(f"own_{c}") for c in offered.columns]  # both sides come from one table
    offered = offered.select(fresh).toDF(*offered.columns)
    met = asked.groupBy(*cells).cogroup(offered.groupBy(*cells)).applyInArrow(meet, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def first_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest ids of each vector; its other copies lose every tie."""
    order = np.argsort(ids, kind="stable")
    kind = np.unique(np.ascontiguousarray(x[order] + 0.0).view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)[1].ravel()
    by = np.argsort(kind, kind="stable")
    first = np.flatnonzero(np.diff(kind[by], prepend=-1))
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[by[place < most]]


def one_each(queries: DataFrame) -> DataFrame:
    """Of rows with one vec_id, the smallest vector asks."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))


def cut(q: np.ndarray, r: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query among found pairs."""
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], r[place < k], score[place < k]
