"""Inputs of the operators, projected from the driver's tables; each with the same projection as SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges: region, nation, customer, order, part; and supplier, part."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    flat = lambda t, a, b, kind: table(spark, sf_dir, t).select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"))
    items = table(spark, sf_dir, "lineitem")
    best = lambda a, kind: items.groupBy(a.alias("src"), tag("p:", "l_partkey").alias("dst")).agg(F.max(1 - F.col("l_discount")).alias("confidence")).select("src", "dst", F.lit(kind).alias("kind"), "confidence")
    return (
        flat("nation", tag("r:", "n_regionkey"), tag("n:", "n_nationkey"), "containment")
        .unionByName(flat("customer", tag("n:", "c_nationkey"), tag("c:", "c_custkey"), "containment"))
        .unionByName(flat("orders", tag("c:", "o_custkey"), tag("o:", "o_orderkey"), "triggers"))
        .unionByName(best(tag("o:", "l_orderkey"), "data_flow"))
        .unionByName(best(tag("s:", "l_suppkey"), "def_use"))
    )


def g_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node: the ends of all typed edges, each once, without the edges."""
    ends = [("nation", "r:", "n_regionkey"), ("nation", "n:", "n_nationkey"), ("customer", "n:", "c_nationkey"), ("customer", "c:", "c_custkey"), ("orders", "c:", "o_custkey"), ("orders", "o:", "o_orderkey"), ("lineitem", "o:", "l_orderkey"), ("lineitem", "p:", "l_partkey"), ("lineitem", "s:", "l_suppkey")]
    parts = [table(spark, sf_dir, t).select(F.lit(tag).alias("tag"), F.col(c).cast("long").alias("key")).distinct() for t, tag, c in ends]
    return reduce(DataFrame.unionByName, parts).distinct().select(F.concat("tag", F.col("key").cast("string")).alias("node"))


def g_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst of the typed edges, some more than once: not grouped, for what makes them unique itself."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ends = [("nation", "r:", "n_regionkey", "n:", "n_nationkey"), ("customer", "n:", "c_nationkey", "c:", "c_custkey"), ("orders", "c:", "o_custkey", "o:", "o_orderkey"), ("lineitem", "o:", "l_orderkey", "p:", "l_partkey"), ("lineitem", "s:", "l_suppkey", "p:", "l_partkey")]
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(tag(p, a).alias("src"), tag(q, b).alias("dst")) for t, p, a, q, b in ends])


G = """g AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'containment' AS kind, CAST(1 AS DOUBLE) AS confidence FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'containment', 1 FROM customer
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'triggers', 1 FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'data_flow', max(1 - l_discount) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'def_use', max(1 - l_discount) FROM lineitem GROUP BY 1, 2
)"""


def hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as hyperedge: from itself to the parts it holds."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")))).alias("target_ids")).select(F.concat(F.lit("h:"), F.col("l_orderkey").cast("string")).alias("edge_id"), F.array(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string"))).alias("source_ids"), "target_ids")


def check_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_id, side, role, status, stable, segment: a customer's first and last order as a check before and after."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    role = F.when(F.col("c_mktsegment") == "BUILDING", "TARGET").when(F.col("c_mktsegment") == "MACHINERY", "PRESERVATION").otherwise("EXPLORATION")
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("TIMEOUT")
    rows = o.select(F.col("o_custkey").alias("check_id"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("c_mktsegment").alias("segment"), role.alias("role"), status.alias("status"), (F.col("o_orderpriority") != "5-LOW").alias("stable"))
    run = F.struct("role", "status", "stable", "segment")
    both = rows.groupBy("check_id").agg(F.min_by(run, "at").alias("BASE"), F.max_by(run, "at").alias("PATCH"))
    return both.unpivot("check_id", ["BASE", "PATCH"], "side", "run").select("check_id", "side", "run.*")


RUNS = """runs AS (
  SELECT check_id, side, role, status, stable, segment FROM (
    SELECT o_custkey AS check_id, c_mktsegment AS segment,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'TARGET' WHEN 'MACHINERY' THEN 'PRESERVATION' ELSE 'EXPLORATION' END AS role,
           CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'TIMEOUT' END AS status,
           o_orderpriority <> '5-LOW' AS stable,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS last
    FROM orders JOIN customer ON o_custkey = c_custkey
  ) JOIN (VALUES ('BASE'), ('PATCH')) s(side) ON (side = 'BASE' AND first = 1) OR (side = 'PATCH' AND last = 1)
),
compared AS (
  SELECT check_id, b.role, b.status AS baseline, a.status AS patched, b.segment,
    CASE WHEN b.status IN ('UNSUPPORTED', 'INVALID_SELECTOR') OR a.status = 'UNSUPPORTED' THEN 'UNSUPPORTED_CHECK'
         WHEN b.status = 'INVALID_ENVIRONMENT' THEN 'SAME_INFRA_FAILURE'
         WHEN a.status IN ('INVALID_ENVIRONMENT', 'INVALID_SELECTOR') THEN 'NEW_INFRA_FAILURE'
         WHEN NOT b.stable OR NOT a.stable OR b.status = 'FLAKY' OR a.status = 'FLAKY' THEN 'FLAKY_RESULT'
         WHEN b.role = 'PRESERVATION' AND b.status = 'PASS' AND a.status = 'FAIL' THEN 'PRESERVATION_REGRESSION'
         WHEN b.status = 'PASS' AND a.status = 'PASS' THEN 'PASS_PRESERVED'
         WHEN b.status = 'FAIL' AND a.status = 'FAIL' THEN 'TARGET_STILL_FAILING'
         WHEN b.status = 'FAIL' AND a.status = 'PASS' THEN 'TARGET_FIXED'
         WHEN b.status = 'PASS' AND a.status = 'FAIL' THEN 'TARGET_REGRESSED'
         ELSE 'FLAKY_RESULT' END AS class
  FROM (SELECT * FROM runs WHERE side = 'BASE') b JOIN (SELECT * FROM runs WHERE side = 'PATCH') a USING (check_id)
)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, requirement, path, kind, status, weight, component: one per lineitem of an order."""
    items = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    status = F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("UNKNOWN")
    kind = F.when(F.col("l_linestatus") == "O", "TARGET").otherwise("PRESERVATION")
    return items.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("unit"), F.col("o_custkey").alias("requirement"), F.col("l_partkey").alias("path"), kind.alias("kind"), status.alias("status"), F.col("l_quantity").alias("weight"), F.col("o_orderpriority").alias("component"))


OUT = """outcome AS (
  SELECT l_orderkey AS unit, o_custkey AS requirement, l_partkey AS path,
         CASE l_linestatus WHEN 'O' THEN 'TARGET' ELSE 'PRESERVATION' END AS kind,
         CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'R' THEN 'FAIL' ELSE 'UNKNOWN' END AS status,
         l_quantity AS weight, o_orderpriority AS component
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def scc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, low = c.agg(F.count("*"), F.min("c_custkey")).first()
    key = F.col("c_custkey")
    return c.select(key.cast("string").alias("src"), ((key * key + F.col("c_nationkey")) % F.lit(max(n, 1)) + F.lit(low)).cast("string").alias("dst"))


SCC = """e AS (
  SELECT CAST(c_custkey AS VARCHAR) AS src, CAST((c_custkey * c_custkey + c_nationkey) % (SELECT count(*) FROM customer) + (SELECT min(c_custkey) FROM customer) AS VARCHAR) AS dst
  FROM customer
)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle, at, event_id, kind, value: the only time series."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle"), "ts", "event_id", F.col("event_type").alias("kind"), "value", "props")


def ordered(by: str = "bundle") -> Window:
    return Window.partitionBy(by).orderBy("ts", "event_id")
