"""Distributed union-find: connected components by hooking to least neighbours, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Stash

#: Rows that a file of these tables holds, about: they shrink from round to round, and so do their tasks and files.
FILE_ROWS = 500_000


def components(edges: DataFrame, stash: Stash, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): the least vertex of v's component, for every vertex of an edge. Edges with a null end are ignored.

    A round hangs each vertex under its least neighbour (if lesser), shortens these trees to their roots by pointer
    jumping, and contracts the edges to the roots: repeated edges fall together and inner ones vanish, so each
    round's table is far smaller than the last. Rounds end when no edge is left; tables are in the shared folder.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    left = stash.put(ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    n = left.count()
    vertices = 2 * n
    labels: DataFrame | None = None

    def put(df: DataFrame, rows: int, name: str) -> DataFrame:
        return stash.put(df.coalesce(max(1, -(-rows // FILE_ROWS))), name)

    while labels is None or n:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = put(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")), 2 * n, "up")
        while True:
            above = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            moved = Observation()  # told by the write itself
            jumped = up.join(above, "p").select("v", F.col("p").alias("old"), F.col("pp").alias("p")).observe(moved, F.count_if(F.col("old") != F.col("p")).alias("n"))
            up = put(jumped.select("v", "p"), 2 * n, "up")
            if not moved.get["n"]:
                break
        labels = up.select("v", F.col("p").alias("root")) if labels is None else put(labels.join(up.select(F.col("v").alias("root"), F.col("p").alias("r")), "root", "left").select("v", F.coalesce("r", "root").alias("root")), vertices, "labels")
        ca, cb = up.select(F.col("v").alias("a"), F.col("p").alias("ra")), up.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        met = left.join(ca, "a").join(cb, "b").where("ra <> rb")
        left = put(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), n, "edges")
        n = left.count()
    return labels
