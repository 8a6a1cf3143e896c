"""Nearest neighbours by largest inner product: one vantage-point tree per shard.

Within a shard equal vectors are taken once (their ids stay in order).  With M the largest norm in
the shard, a vector x is lifted to (x, sqrt(M^2 - |x|^2)) and a query q to (q, 0), which makes
the Euclidean order the order of inner products.  A node parts its points at the median distance to
a vantage point and keeps each side's least and greatest distance; by the triangle inequality a side
whose bound exceeds ``factor`` times the distance of the k-th best so far is skipped.  Factor 1 is
exact search; smaller factors skip more.  Every row is indexed; queries and shards meet in blocks
of bounded size.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intakeflow.llm.common import written
from intakeflow.llm.vectors import matrix, typed, usable

SHARD_ROWS = 4096
QUERY_ROWS = 8192
LEAF = 128
FACTOR = 0.3
SLACK = 8  # further vectors kept besides the k best; where these reach the k-th product, the shard is gone through
MARGIN = 1e-9  # of the norms' product, far above the rounding of products in bulk


class Tree:
    """Vantage-point tree over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 5):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)
        key = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        self.x = vectors[first]
        by = np.argsort(group, kind="stable")
        self.ids = ids[by]                 # ids of vector i: ids[at[i]:at[i + 1]], rising
        self.at = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
        norm2 = (self.x * self.x).sum(1)
        self.top2 = float(norm2.max())
        lift = np.sqrt(np.maximum(self.top2 - norm2, 0))
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(first))
        self.nodes: list[tuple] = []       # (vantage, (lo, hi, node) x 2) or (start, end)

        def build(lo: int, hi: int) -> int:
            me = len(self.nodes)
            self.nodes.append(())
            some = self.order[lo:hi]
            if hi - lo <= leaf:
                self.nodes[me] = (lo, hi)
                return me
            v = int(some[rng.integers(len(some))])
            d = np.sqrt(np.maximum((self.x[some] - self.x[v]) ** 2 @ np.ones(self.x.shape[1])
                                   + (lift[some] - lift[v]) ** 2, 0))
            rank = np.argsort(d, kind="stable")
            self.order[lo:hi], d = some[rank], d[rank]
            mid = (hi - lo) // 2
            self.nodes[me] = (v, (d[0], d[mid - 1], build(lo, lo + mid)), (d[mid], d[-1], build(lo + mid, hi)))
            return me

        build(0, len(first))
        self.lift = lift

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and products of the best ``k`` vectors of every query (-inf: none)."""
        n, width = len(q), min(k, len(self.x))
        best = np.full((n, width), -np.inf)
        item = np.full((n, width), -1)
        base = (q * q).sum(1) + self.top2

        def reach(rows):
            kth = best[rows].min(1)
            return np.sqrt(np.maximum(base[rows] - 2 * np.where(np.isfinite(kth), kth, -1e300), 0))

        def leaf(rows, lo, hi):
            some = self.order[lo:hi]
            s = q[rows] @ self.x[some].T
            hit = np.flatnonzero((s > best[rows].min(1)[:, None]).any(1))
            if len(hit):
                r = rows[hit]
                both = np.concatenate([best[r], s[hit]], 1)
                what = np.concatenate([item[r], np.broadcast_to(some, (len(r), len(some)))], 1)
                top = np.argpartition(-both, width - 1, 1)[:, :width]
                best[r] = np.take_along_axis(both, top, 1)
                item[r] = np.take_along_axis(what, top, 1)

        def distance(rows, v):
            # the lifted vantage point keeps its own last coordinate, a query has none
            return np.sqrt(np.maximum(base[rows] - 2 * (q[rows] @ self.x[v]), 0))

        seen: dict[int, np.ndarray] = {}

        def descend(node, rows):  # each query to the leaf on its own side first
            while len(rows):
                what = self.nodes[node]
                if len(what) == 2:
                    leaf(rows, *what)
                    seen[node] = rows
                    return
                d = distance(rows, what[0])
                inner = d <= (what[1][1] + what[2][0]) / 2
                descend(what[1][2], rows[inner])
                node, rows = what[2][2], rows[~inner]

        def visit(node, rows):
            what = self.nodes[node]
            if len(what) == 2:
                done = seen.get(node)
                rows = rows if done is None else np.setdiff1d(rows, done, assume_unique=True)
                if len(rows):
                    leaf(rows, *what)
                return
            d = distance(rows, what[0])
            for lo, hi, child in what[1:]:
                bound = np.maximum(np.maximum(lo - d, d - hi), 0)
                near = rows[bound <= factor * reach(rows)]
                if len(near):
                    visit(child, near)

        rows = np.arange(n)
        descend(0, rows)
        visit(0, rows)
        return item, best

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> pd.DataFrame:
        """The k nearest rows of the shard to every query but the query's own: (query_id, vec_id, score)."""
        item, best = self.search(q, k + 1 + SLACK, factor)
        out_q, out_v, out_s = [], [], []
        margin = MARGIN * np.sqrt(self.top2 * (q * q).sum(1))
        for i, row in enumerate(item):
            row = row[row >= 0]
            if k < len(row) < len(self.x):
                # the query's own vector may be among the best, so the one after the k-th decides
                kth = np.partition(best[i], -(k + 1))[-(k + 1)]
                if best[i].min() >= kth - margin[i]:  # others may be as near as the last ones kept
                    row = np.flatnonzero(self.x @ q[i] >= kth - margin[i])
            s = (self.x[row] * q[i]).sum(1)
            order = np.argsort(-s, kind="stable")
            size = np.minimum(self.at[row + 1] - self.at[row], k + 1)
            ids = np.concatenate([self.ids[self.at[r]:self.at[r] + c] for r, c in zip(row[order], size[order])])
            s = np.repeat(s[order], size[order])
            keep = ids != query_ids[i]
            ids, s = ids[keep], s[keep]
            top = np.lexsort((ids, -s))[:k]
            out_q.append(np.full(len(top), query_ids[i]))
            out_v.append(ids[top])
            out_s.append(s[top])
        cat = (lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t))
        return pd.DataFrame({"query_id": cat(out_q, "i8"), "vec_id": cat(out_v, "i8"), "score": cat(out_s, "f8")})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR,
           shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors (vec_id, embedding)`` with the largest inner product with every row
    of ``queries`` (same columns), rows with the query's own id left out.

    Returns query_id, rank (from 1), vec_id, score; equal scores go to the smaller vec_id.  Unusable
    vectors and rows without an id take no part; rows that share an id are all found, and of queries that share
    one the smallest vector counts; vectors are compared with those of equal length only.  Empty tables give an empty result.
    """
    def clean(df):
        return typed(df).where(F.col("vec_id").isNotNull() & usable()).withColumn("dim", F.size("embedding"))

    base = written(clean(vectors), "vp-vectors")
    asked = written(clean(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
                    .withColumn("dim", F.size("embedding")), "vp-queries")
    shards = max(1, -(-base.count() // shard_rows))
    chunks = max(1, -(-asked.count() // query_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(), matrix(pdf["embedding"]))
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="i8"), "vec_id": pd.Series(dtype="i8"),
                                 "score": pd.Series(dtype="f8")})
        tree = pickle.loads(left["tree"].iloc[0])
        right = right.sort_values("vec_id")
        return tree.nearest(right["vec_id"].to_numpy(), matrix(right["embedding"]), k, factor)

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    trees = written(base.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()),
                                                     F.lit(shards)).cast("int"))
                    .groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"), "vp-trees")
    left = trees.withColumn("chunk", spread(chunks))
    right = (asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
             .withColumn("shard", spread(shards)))
    keys = ["dim", "shard", "chunk"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        match, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
