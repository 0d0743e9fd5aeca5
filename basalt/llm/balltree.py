"""Exact top-k by inner product: a ball tree in each shard, searched best first with branch and bound.

A node's ball (centre c, radius r) bounds the inner product of a query q with anything inside by q.c + |q| r.
Nodes are visited by falling bound until it is below the k-th best score known. That score is shared: shards are
searched in waves of one, one, two, four and so on, and each wave starts from the k-th scores of all waves before it.

Queries go in blocks, vectors in shards; a task holds one of each, both of bounded size. Vectors that are null, or
hold null or non-finite components, or have a null id take no part. Vectors of different length meet over the
shorter one's components. Repeated ids are kept apart: each row is a query or candidate of its own, and a query only
leaves its own row out. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

LEAF = 64


class BallTree:
    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        """x: float64 rows."""
        self.x, self.order = x, np.arange(len(x))
        self.nodes: list[tuple[int, int, int]] = []  # first, end, left child (right is next to it) or -1
        centres, radii = [], []
        todo = [(0, len(x), None)]
        while todo:
            first, end, slot = todo.pop()
            rows = x[self.order[first:end]]
            c = rows.mean(axis=0)
            d = np.sqrt(((rows - c) ** 2).sum(axis=1))
            node = (first, end, -1)
            if slot is None:
                slot = len(self.nodes)
                self.nodes.append(node)
                centres.append(c)
                radii.append(d.max())
            else:
                self.nodes[slot], centres[slot], radii[slot] = node, c, d.max()
            if end - first > leaf and d.max() > 0:
                far = rows[d.argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                side = rows @ (other - far)
                split = np.argsort(side, kind="stable")
                self.order[first:end] = self.order[first:end][split]
                mid = (first + end) // 2
                left = len(self.nodes)
                self.nodes[slot] = (first, end, left)
                for _ in range(2):
                    self.nodes.append((0, 0, -1))
                    centres.append(c)
                    radii.append(0.0)
                todo += [(first, mid, left), (mid, end, left + 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.sorted = x[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds, queries by nodes; widened for rounding."""
        norms = np.sqrt((q * q).sum(axis=1))
        ub = q @ self.centres.T + norms[:, None] * self.radii[None, :]
        return ub + 1e-9 * (norms[:, None] * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)[None, :]) + 1e-6


def search(tree: BallTree, ids: np.ndarray, rows: np.ndarray, exact: np.ndarray, q: np.ndarray, q_exact: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query number, id, score) of each query's best k here that reach its floor. exact: what scores are made of;
    rows, q_rows: row numbers, so that a query doesn't meet itself."""
    if not len(q):
        return
    ub = tree.bounds(q)
    place, row = ids[tree.order], rows[tree.order]
    vectors = exact[tree.order]
    for j in range(len(q)):
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst on top
        limit = floor[j]
        heap = [(-ub[j, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < limit:
                break
            first, end, left = tree.nodes[node]
            if left >= 0:
                for child in (left, left + 1):
                    if ub[j, child] >= limit:
                        heapq.heappush(heap, (-ub[j, child], child))
                continue
            scores = vectors[first:end] @ q_exact[j]
            for i in np.flatnonzero((scores >= limit) & (row[first:end] != q_rows[j])).tolist():
                item = (int(scores[i]), -int(place[first + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                limit = max(limit, best[0][0])
        for score, i in best:
            yield j, -i, score


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), dtype=np.int64)
    lens = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lists) and (lens == dim).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    for i, v in enumerate(lists.to_pylist()):
        out[i, : len(v)] = v
    return out


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """row (a number), id and vec array<bigint>: floor(scale * x) of each component; rows that take no part are gone."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def top_k(vectors: DataFrame, asks: Column, k: int, shard_rows: int = 8192, block_rows: int = 2048, stash: Stash | None = None) -> DataFrame:
    """vectors: row bigint (unique), id bigint, vec array<bigint>; asks: which of them are queries, too. Returns
    query_id, rank, vec_id, score: k rows for each query row, fewer if there are not so many others."""
    spark = vectors.sparkSession
    stash = stash or Stash(spark, "topk")
    vectors = stash.put(vectors, "rows")  # numbered once: a task run again must not number anew
    queries = vectors.where(asks)
    n, n_q = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_q // block_rows))
    sharded = stash.put(vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "vectors")
    blocked = stash.put(queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")), "queries")
    found_schema = "query long, query_id long, vec_id long, score long"

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        got = left.column("vec").combine_chunks(), right.column("vec").combine_chunks()
        xs, qs = (pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a for a in got)
        rows = []
        if len(xs) and len(qs):
            dim = max(int(np.max(a.value_lengths().to_numpy(zero_copy_only=False))) for a in (xs, qs))
            x, q = _matrix(xs, dim), _matrix(qs, dim)
            top = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(dim, 1)
            xf, qf = x.astype(float), q.astype(float)
            exact = (xf, qf) if top < 2.0**53 else (x, q)
            floor = right.column("floor").to_numpy().astype(float)
            q_ids, q_rows = right.column("id").to_numpy(), right.column("row").to_numpy()
            rows = [(int(q_rows[j]), int(q_ids[j]), i, s) for j, i, s in search(BallTree(xf), left.column("id").to_numpy(), left.column("row").to_numpy(), exact[0], qf, exact[1], q_rows, floor, k)]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "query_id", "vec_id", "score"), cols, strict=True)})

    def wave(first: int, end: int, asked: DataFrame) -> DataFrame:
        """Shards first to end - 1, each with every block."""
        data = sharded.where((F.col("shard") >= first) & (F.col("shard") < end)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        ask = asked.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
        return data.groupBy("shard", "block").cogroup(ask.groupBy("shard", "block")).applyInArrow(task, found_schema)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    lowest = -(1 << 62)
    found, done = spark.createDataFrame([], found_schema), 0
    while done < shards:
        end = min(shards, max(1, 2 * done))
        kth = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query").alias("row"), "floor")
        ask = blocked.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(lowest)).cast("long"))
        found = stash.put(best(found.unionByName(wave(done, end, ask))).drop("rank"), "best")
        done = end
    return best(found).select("query_id", "rank", "vec_id", "score")
