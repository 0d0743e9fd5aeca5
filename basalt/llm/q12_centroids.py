"""Query op12: eight clusters of the embeddings after ten rounds."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster, finite, first_by, integers
from .common import ship, table

DIM, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "embeddings").where(finite("embedding", DIM)).select(F.col("vec_id").alias("id"), integers("embedding", SCALE).alias("vec"))
    start = first_by(rows, F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")).cast("binary"), 256), K)
    members, centroids = cluster(rows, start, ROUNDS)
    sums = {r["cluster"]: r["s"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most K rows
    facts = [(k, sums.get(k, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(known), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds laid out one after another."""
    parts = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM k QUALIFY cluster < {K}
)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT k.*, cluster, CAST(list_sum(list_transform(range(1, {DIM} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM k, c{r})
  GROUP BY rid
)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
      SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {DIM} + 1) AS t(i) GROUP BY cluster, i
    ) GROUP BY cluster
  ) AS moved ON moved.cluster = c{r}.cluster
)"""
            )
    return (
        "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON a.cluster = c.cluster
"""
    )


QUERIES = {"op12_centroids": op12_centroids}
ORACLES = {"op12_centroids": _sql()}
