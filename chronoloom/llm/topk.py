"""Exact top-k search by inner product (operator 1): a ball tree per shard, branch and bound.

Vectors are dealt over shards by a hash of a row number, so that ids may repeat. A task holds one shard and one block of
queries: it builds a ball tree and walks it with all queries of the block at once, visiting the child
of the larger inner-product upper bound (centre product plus norm times radius) first and
dropping a query where the bound is below its current kth score. A first pass over a pilot shard
gives every query a kth score that all other shards share as their starting bound. The best k of
each shard meet in an aggregation by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 512
_NONE = np.iinfo(np.int64).min


def _matrix(vectors) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(list(vectors), np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


class BallTree:
    """Nodes hold a range of the ordered rows, a centre and a radius; children split at the median."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points.astype(np.float64)
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._build(0, len(points))
        self.points = self.points[self.order]

    def _build(self, lo: int, hi: int) -> int:
        part = self.points[self.order[lo:hi]]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        node = len(self.nodes)
        self.nodes.append((lo, hi, centre, float(away.max()), -1, -1))
        if hi - lo > LEAF and away.max() > 0:
            a = part[away.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            along = part @ (b - a)
            self.order[lo:hi] = self.order[lo:hi][np.argsort(along, kind="stable")]
            mid = (lo + hi) // 2
            left, right = self._build(lo, mid), self._build(mid, hi)
            self.nodes[node] = (*self.nodes[node][:4], left, right)
        return node


def search(queries: np.ndarray, query_rows: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (best first; the lowest integer where there are fewer) of each query's k best points.

    A point isn't found by the query of its own row (``rows``; without them, ids stand for rows).
    ``floor`` is each query's kth score known so far: points below it can't be among its k best.
    """
    by_id = np.argsort(ids, kind="stable")
    rows = (ids if rows is None else rows)[by_id]
    points, ids = points[by_id], ids[by_id]
    width = max(queries.shape[1], points.shape[1])
    queries, points = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, points))
    tree = BallTree(points)
    # products of integers are exact in float64 while their sums stay below 2**53
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(1, width) < 2**53
    q, whole = queries.astype(np.float64), points[tree.order]
    norms = np.sqrt((q**2).sum(axis=1))
    best = np.full((len(q), k), _NONE)
    place = np.full((len(q), k), len(ids))  # positions in id order: the smaller wins ties
    bound = floor.astype(np.int64).copy()

    def leaf(lo: int, hi: int, at: np.ndarray) -> None:
        scores = np.rint(q[at] @ tree.points[lo:hi].T).astype(np.int64) if exact else queries[at] @ whole[lo:hi].T
        where = np.broadcast_to(tree.order[lo:hi], scores.shape)
        own = rows[tree.order[lo:hi]][None, :] == query_rows[at][:, None]
        scores = np.where(own | (scores < bound[at][:, None]), _NONE, scores)
        some = (scores > _NONE).any(axis=1)
        if not some.any():
            return
        at, scores, where = at[some], scores[some], where[some]
        if scores.shape[1] > 4 * k:  # the k best by score, ties by place, are among these
            cut = np.partition(scores, -k, axis=1)[:, -k]
            wide = int((scores >= cut[:, None]).sum(axis=1)[cut > _NONE].max(initial=k))
            top = np.argpartition(scores, -max(wide, k), axis=1)[:, -max(wide, k) :] if wide < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
            scores, where = np.take_along_axis(scores, top, 1), np.take_along_axis(where, top, 1)
        scores = np.concatenate([best[at], scores], axis=1)
        where = np.concatenate([place[at], where], axis=1)
        first = np.lexsort((where, -scores.astype(np.float64) if exact else ~scores), axis=1)[:, :k]
        best[at], place[at] = np.take_along_axis(scores, first, 1), np.take_along_axis(where, first, 1)
        bound[at] = np.maximum(bound[at], best[at][:, -1])

    def visit(node: int, at: np.ndarray) -> None:
        lo, hi, _, _, left, right = tree.nodes[node]
        if left < 0:
            return leaf(lo, hi, at)
        upper = {c: q[at] @ tree.nodes[c][2] + norms[at] * tree.nodes[c][3] for c in (left, right)}
        for child in sorted(upper, key=lambda c: -upper[c].mean()):
            alive = upper[child] * (1 + 1e-9) + 1e-6 * (1 + norms[at]) >= bound[at]
            if alive.any():
                visit(child, at[alive])

    if len(q) and len(ids):
        visit(0, np.arange(len(q)))
    return best, np.where(place < len(ids), ids[np.minimum(place, max(0, len(ids) - 1))] if len(ids) else 0, 0)


def scaled(embeddings: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v): floor(factor * x) of the components; null or non-finite vectors are left out."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return embeddings.where(usable).where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), vectors.alias("v"))


def _searched(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Joins query blocks (block, query_id, query_row, q, floor) and shards (shard, block, row, vec_id, v) task by task."""

    def task(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ("query_id", "query_row", "vec_id", "score")
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        score, ids = search(_matrix(left["q"]), left["query_row"].to_numpy(), _matrix(right["v"]), right["vec_id"].to_numpy(), k, left["floor"].to_numpy(), right["row"].to_numpy())
        row, column = np.nonzero(score > _NONE)
        return pd.DataFrame(dict(zip(names, (left["query_id"].to_numpy()[row], left["query_row"].to_numpy()[row], ids[row, column], score[row, column]))))

    return queries.groupBy("shard", "block").cogroup(points.groupBy("shard", "block")).applyInPandas(task, "query_id long, query_row long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_top_k(embeddings: DataFrame, is_query, k: int = 20, shard_rows: int = 50_000, block_rows: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to smaller ids.

    ``is_query`` is a condition on vec_id; candidates are all rows but the query's own. Rows with a
    null id, a null vector, or null or non-finite components take no part; shorter vectors count as filled up with
    zeros, and an empty one scores 0 with all. Every row is a candidate, and every row of a query's id a query with
    results of its own; ties of score go by vec_id, and rows of one vec_id and score are alike. Fewer than k
    candidates give fewer rows; empty tables give none. Other columns are ignored.
    """
    points = written(scaled(embeddings).withColumn("row", F.monotonically_increasing_id()))
    n, n_queries = points.count(), points.where(is_query).count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    points = points.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    queries = points.where(is_query).select(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q"))
    lowest = F.lit(_NONE + 1)
    pilot = points.where(F.pmod(F.xxhash64("row", F.lit(2)), F.lit(max(1, n // 4096))) == 0).select("row", "vec_id", "v", F.lit(0).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    first = _searched(queries.withColumn("shard", F.lit(0)).withColumn("floor", lowest), pilot, k)
    floors = _ranked(first, k).groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    started = queries.join(floors, "query_row", "left").withColumn("floor", F.coalesce("floor", lowest)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return _ranked(_searched(started, dealt, k), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
