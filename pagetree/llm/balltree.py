"""Exact top-k inner products with a ball tree per shard and branch and bound.

Vectors are dealt to shards by the hash of their id, and each shard builds a ball tree.  No vector of
a ball with centre c and radius r has a product with q above q.c + |q| r; nodes are visited in the
order of this bound, and a node whose bound is below a query's k-th score so far is left out for that
query.  A first round lets every query search one shard; the k-th score found there goes with the
query to all other shards and prunes from the start.  Queries search in blocks, so that a leaf is one
matrix product.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

_EXACT = 1 << 53
_NONE = -(1 << 63)


@dataclass(frozen=True)
class TopKSettings:
    """``shard_rows`` vectors and ``query_rows`` queries at most about meet in one task."""

    k: int = 20
    shard_rows: int = 16_384
    query_rows: int = 16_384
    leaf: int = 256
    block: int = 256


class BallTree:
    """A ball tree over the rows of an integer matrix, in the order of ``ids``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int):
        self.rows, self.order = rows.astype(np.float64), np.arange(len(ids))
        self.nodes = []  # centre, radius, begin, end, first child (or -1), second child
        self._grow(0, len(ids), leaf)
        self.ids, self.rows, self.whole = ids[self.order], self.rows[self.order], rows[self.order]

    def _grow(self, begin: int, end: int, leaf: int) -> int:
        part = self.rows[self.order[begin:end]]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())) if len(part) else 0.0
        number = len(self.nodes)
        self.nodes.append((centre, radius, begin, end, -1, -1))
        if end - begin > leaf:
            axis, middle = int((part.max(axis=0) - part.min(axis=0)).argmax()), (end - begin) // 2
            self.order[begin:end] = self.order[begin:end][np.argpartition(part[:, axis], middle)]
            children = self._grow(begin, begin + middle, leaf), self._grow(begin + middle, end, leaf)
            self.nodes[number] = (centre, radius, begin, end, *children)
        return number

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Not below any product with a row of the node, rounding included."""
        centre, radius = self.nodes[node][:2]
        return (queries @ centre + norms * radius) + 1e-9 * (1 + norms * (radius + float(np.abs(centre).max(initial=0)) * len(centre)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), a row per query, best first; ``_NONE`` where there are fewer.

        ``floor`` holds scores that the k-th is known to reach.
        """
        m = len(queries)
        scores, ids = np.full((m, k), _NONE, np.int64), np.full((m, k), np.iinfo(np.int64).max)
        reached = floor.copy()
        real = queries.astype(np.float64)
        norms = np.sqrt((real**2).sum(axis=1))
        largest = float(np.abs(real).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * real.shape[1]
        exact = largest < _EXACT
        first = self.bound(0, real, norms)
        heap = [(-float(first.max(initial=0)), 0, np.arange(m), first)]
        while heap:
            _, node, active, bounds = heapq.heappop(heap)
            active = active[bounds >= reached[active]]
            if not len(active):
                continue
            _, _, begin, end, *children = self.nodes[node]
            if children[0] >= 0:
                for child in children:
                    bounds = self.bound(child, real[active], norms[active])
                    heapq.heappush(heap, (-float(bounds.max()), child, active, bounds))
                continue
            if exact:
                found = (real[active] @ self.rows[begin:end].T).astype(np.int64)
            else:
                found = queries[active] @ self.whole[begin:end].T
            own = self.ids[None, begin:end]
            allowed = (own != query_ids[active, None]) & (found >= reached[active, None])
            some = allowed.any(axis=1)
            active, found, allowed = active[some], found[some], allowed[some]
            if not len(active):
                continue
            both = np.concatenate((scores[active], np.where(allowed, found, _NONE)), axis=1)
            names = np.concatenate((ids[active], np.where(allowed, own, np.iinfo(np.int64).max)), axis=1)
            best = np.lexsort((names, -(both.astype(object) if not exact else np.maximum(both, -(1 << 62)))), axis=-1)[:, :k]
            scores[active], ids[active] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            reached[active] = np.maximum(reached[active], scores[active, -1])
        return scores, ids


def usable(vector: Column | str) -> Column:
    """No null and only finite components."""
    column = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(column.isNotNull() & ~bad, F.lit(False))


def whole_numbers(vector: Column | str, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("v").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False) if len(values) else np.empty(0, np.int64)
    return flat.reshape(len(table), -1) if len(flat) else np.zeros((len(table), 0), np.int64)


def _search(left: pa.Table, right: pa.Table, how: TopKSettings) -> pa.Table:
    """The queries on the right over the vectors on the left."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        ids, rows = left.column("vec_id").to_numpy(), _matrix(left)
        if len(np.unique(ids)) < len(ids):  # repeated rows count once
            once = np.unique(np.column_stack((ids, rows)), axis=0)
            ids, rows = once[:, 0], once[:, 1:]
        tree = BallTree(ids, rows, how.leaf)
        queries, at = np.unique(right.column("vec_id").to_numpy(), return_index=True)
        data, floor = _matrix(right)[at], right.column("floor").to_numpy()[at]
        for begin in range(0, len(queries), how.block):
            part = slice(begin, begin + how.block)
            scores, names = tree.search(queries[part], data[part], floor[part], how.k)
            found = names != np.iinfo(np.int64).max
            out["query_id"].append(np.repeat(queries[part], found.sum(axis=1)))
            out["vec_id"].append(names[found])
            out["score"].append(scores[found])
    return pa.table({k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()})


def top_k(vectors: DataFrame, queries: DataFrame, how: TopKSettings = TopKSettings()) -> DataFrame:  # noqa: B008
    """(query_id, rank, vec_id, score): the ``how.k`` highest products of each query.

    Both tables have vec_id and ``v``, an array of long without nulls.  A vector is no candidate of
    the query with its own id.  Ties go to the smaller vec_id.  Vectors meet queries of their own
    length only; null ids take no part; rows equal in id and vector count once, and a query id with
    several vectors is searched with one of them.  Empty tables give an empty result.  Products are
    exact below 2**63.
    """
    schema = "query_id long, vec_id long, score long"
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"))
    asked = queries.where("vec_id is not null").select(F.col("vec_id").cast("long"), "v", F.size("v")).toDF("vec_id", "v", "dim")
    shards = max(1, -(-rows.count() // how.shard_rows))
    blocks = max(1, -(-asked.count() // how.query_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    seed = asked.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("floor", F.lit(_NONE))

    def one(left, right):
        return _search(left, right, how)

    seed = seed.toDF(*seed.columns)  # names of its own, as both sides may come from one table
    first = staged(rows.groupBy("shard", "dim").cogroup(seed.groupBy("shard", "dim")).applyInArrow(one, schema))
    reached = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least")).where(F.col("_n") >= how.k)
    others = asked.join(reached, asked["vec_id"] == reached["query_id"], "left").select(
        "vec_id", "v", "dim", F.coalesce("_least", F.lit(_NONE)).alias("floor"),
        F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("part"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("done"),
    )
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> done")
    others = others.toDF(*others.columns)
    spread = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["shard", "part", "dim"]
    rest = spread.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(one, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
