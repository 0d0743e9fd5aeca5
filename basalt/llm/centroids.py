"""Centroid clustering of integer vectors by ball-tree filtering; every number is exact.

Each task cuts its rows into shards of bounded size and builds a metric tree in each: a ball has its rows' mean as
centre, its radius, count and integer sum. Trees are written once, and each round only reads them. A ball whose centre
is so much nearer to one centroid than to another that, by the triangle inequality, all of its rows are nearer, drops
the other; with one centroid left, its whole sum and count are added to that one, else its children go on with the
centroids left. What reaches a leaf is compared vector by vector, in integers. Copies of a vector fill balls of radius
0, which are one comparison. Trees of a task advance level by level, all balls of a level in one matrix product.

A round sends a row per centroid and component from each task, which Spark sums; the driver holds the centroids alone
(k vectors). Ties go to the smaller centroid number; a mean is floor(sum / count) per component; empty centroids stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash

SHARD_ROWS, LEAF = 8192, 32
#: Sums of products of components up to this are exact in doubles for 512 components; above, int64 and Python's own
#: integers are used.
SMALL = 1 << 21
#: Radii are widened by this share for rounding.
SLACK = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, rows by centroids."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top <= SMALL and x.shape[1] <= 512:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2.0 * (xf @ cf.T) + (cf * cf).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if 4.0 * float(top) ** 2 * x.shape[1] < 2.0**63 else object
    return np.stack([((x.astype(kind) - row) ** 2).sum(axis=1) for row in c.astype(kind)], axis=1)


class Tree:
    """A ball tree over integer rows, as flat arrays, so that it can be a row of a table."""

    FIELDS = (("order", "i4"), ("first", "i4"), ("end", "i4"), ("left", "i4"), ("radius", "f8"), ("sums", "i8"), ("rows", "i8"))

    def __init__(self, dim: int, **arrays: np.ndarray):
        self.dim = dim
        for name, _ in self.FIELDS:
            setattr(self, name, arrays[name])
        self.rows, self.sums = self.rows.reshape(-1, dim), self.sums.reshape(-1, dim)
        self.count = (self.end - self.first).astype(np.int64)
        self.centre = self.sums / self.count[:, None]

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(x))
        xf = x.astype(np.float64)
        nodes: list[list[int]] = [[0, len(x), -1]]
        radii, sums, todo = [0.0], [x.sum(axis=0)], [0]
        while todo:
            k = todo.pop()
            first, end, _ = nodes[k]
            mine = order[first:end]
            total = x[mine].sum(axis=0)
            away = np.sqrt(((xf[mine] - total / len(mine)) ** 2).sum(axis=1))
            sums[k], radii[k] = total, float(away.max())
            if end - first <= leaf or (x[mine] == x[mine[0]]).all():
                continue
            pole = xf[mine[away.argmax()]]
            other = xf[mine[((xf[mine] - pole) ** 2).sum(axis=1).argmax()]]
            order[first:end] = mine[np.argsort(xf[mine] @ (other - pole), kind="stable")]
            mid, nodes[k][2] = (first + end) // 2, len(nodes)
            for a, b in ((first, mid), (mid, end)):
                todo.append(len(nodes))
                nodes.append([a, b, -1])
                radii.append(0.0)
                sums.append(total)
        flat = np.array(nodes, dtype=np.int32)
        return cls(x.shape[1], order=order.astype(np.int32), first=flat[:, 0], end=flat[:, 1], left=flat[:, 2], radius=np.array(radii), sums=np.array(sums, dtype=np.int64), rows=x[order])

    def pack(self) -> dict[str, bytes]:
        return {n: np.ascontiguousarray(getattr(self, n), dtype=d).tobytes() for n, d in self.FIELDS}

    @classmethod
    def unpack(cls, dim: int, blobs: dict[str, bytes]) -> Tree:
        return cls(dim, **{n: np.frombuffer(blobs[n], dtype=d) for n, d in cls.FIELDS})

    def assign(self, centroids: np.ndarray, whole, single) -> int:
        """whole(node, centroid) for each ball that goes as one, single(places, centroid numbers, squared distances) for
        the rows of a leaf, in one lot for all leaves of a level. Returns the balls looked at."""
        cf = centroids.astype(np.float64)
        squares = (cf * cf).sum(axis=1)
        at, open_ = np.array([0]), np.ones((1, len(cf)), dtype=bool)
        seen = 0
        while len(at):
            seen += len(at)
            m = self.centre[at]
            far = np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] - 2.0 * (m @ cf.T) + squares[None, :], 0.0))
            far[~open_] = np.inf
            best = far.min(axis=1)
            scale = np.sqrt((m * m).sum(axis=1) + squares.max()) + 1.0
            reach = self.radius[at] + SLACK * scale + np.sqrt(SLACK) * 1e-2 * scale  # the square root of a rounded difference
            open_ = open_ & (far - reach[:, None] <= (best + reach)[:, None])
            one = open_.sum(axis=1) == 1
            for node, c in zip(at[one].tolist(), open_[one].argmax(axis=1).tolist(), strict=True):
                whole(node, c)
            leaf = ~one & (self.left[at] < 0)
            if leaf.any():
                first, n = self.first[at[leaf]].astype(np.int64), self.count[at[leaf]]
                places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                d = squared(self.rows[places], centroids)
                c = d.argmin(axis=1)
                single(places, c, d[np.arange(len(c)), c])
            on = ~one & ~leaf
            left, mask = self.left[at[on]], open_[on]
            at, open_ = np.concatenate([left, left + 1]), np.concatenate([mask, mask])
        return seen


def integers(vec: str | Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: F.floor(x.cast("double") * scale))


def finite(vec: str, dim: int) -> Column:
    """Has vec exactly dim components, none null or non-finite?"""
    v = F.col(vec)
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def first_by(vectors: DataFrame, order: Column, k: int) -> np.ndarray:
    """The k vectors that come first; ties go by the vector itself, nulls last."""
    got = vectors.orderBy(order.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    return np.array([r["vec"] for r in got], dtype=np.int64) if got else np.zeros((0, 0), dtype=np.int64)


def _plant(vectors: DataFrame, dim: int, shard_rows: int, stash: Stash) -> DataFrame:
    """A row per shard: its ids and its tree."""
    id_type = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(n, T.BinaryType()) for n, _ in Tree.FIELDS]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            x = t.column("vec").combine_chunks()
            tree = Tree.build(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64))
            blobs = tree.pack()
            ids = t.column("id").combine_chunks().take(pa.array(tree.order))
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([lists, *[pa.array([blobs[n]], pa.binary()) for n, _ in Tree.FIELDS]], names=["ids", *blobs])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, shard_rows - n)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == shard_rows:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    return stash.put(vectors.select("id", "vec").mapInArrow(task, schema), "trees")


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for k in range(batch.num_rows):
        yield batch.column(0).slice(k, 1).flatten(), Tree.unpack(dim, {n: batch.column(n)[k].as_py() for n, _ in Tree.FIELDS})


def _round(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, component, total, n of one assignment; at most k * dim rows a task."""
    k, dim = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, tree in _trees(batch, dim):

                def whole(node: int, c: int, t: Tree = tree) -> None:
                    total[c] += t.sums[node]
                    n[c] += t.count[node]

                def single(places: np.ndarray, c: np.ndarray, _d: np.ndarray, t: Tree = tree) -> None:
                    for j in np.unique(c).tolist():
                        total[j] += t.rows[places[c == j]].sum(axis=0)
                    n[:] += np.bincount(c, minlength=k)

                tree.assign(centroids, whole, single)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(used)), pa.int32()), pa.array(total[used].ravel(), pa.int64()), pa.array(np.repeat(n[used], dim), pa.int64())],
            names=["cluster", "component", "total", "n"],
        )

    return trees.mapInArrow(task, "cluster int, component int, total long, n long").groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _members(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance of every vector: whole balls get their cluster from the tree, distances are worked out row
    by row."""
    dim, id_type = centroids.shape[1], trees.schema["ids"].dataType.elementType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, dim):
                cluster, distance = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids), dtype=object)

                def whole(node: int, c: int, t: Tree = tree, cl=cluster, di=distance) -> None:
                    a, b = t.first[node], t.end[node]
                    cl[a:b] = c
                    di[a:b] = squared(t.rows[a:b], centroids[c : c + 1])[:, 0]

                def single(places: np.ndarray, c: np.ndarray, d: np.ndarray, cl=cluster, di=distance) -> None:
                    cl[places], di[places] = c, d

                tree.assign(centroids, whole, single)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array([int(d) for d in distance], pa.int64())], names=["id", "cluster", "distance"])

    return trees.mapInArrow(task, T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(vectors: DataFrame, start: np.ndarray, rounds: int, stash: Stash | None = None, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster and squared distance of each row; the final centroids). vectors: id, vec array<bigint>, all of the
    length of the start centroids. Rows of the same id or vector are rows of their own; no row gives no row. A squared
    distance above 2^63 is an error."""
    spark = vectors.sparkSession
    stash = stash or Stash(spark, "centroids")
    centroids = start
    trees = _plant(vectors, centroids.shape[1], shard_rows, stash) if len(start) else None
    if trees is None:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), start
    for _ in range(rounds):
        sums = _round(trees, centroids).collect()  # k * dim rows
        moved = centroids.copy()
        for r in sums:
            moved[r["cluster"], r["component"]] = r["total"] // r["n"]  # Python's // rounds down
        if (moved == centroids).all():
            break  # further rounds change nothing
        centroids = moved
    return stash.put(_members(trees, centroids), "members"), centroids
