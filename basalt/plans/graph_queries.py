"""Queries over the edge projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as ops
from .projections import SCC, G, g_edges, hyper, scc_edges, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _walk(start: str, step: str, where: str = "true") -> str:
    """Recursive reach with UNION: node by node, each once."""
    return f"WITH RECURSIVE {G}, t(node) AS ({start} UNION SELECT {step} WHERE {where})"


@query(f"WITH RECURSIVE {G}, t(node) AS (SELECT 'r:0' UNION SELECT g.dst FROM g JOIN t ON g.src = t.node) SELECT node FROM t")
def graph_reach(spark, sf_dir):
    start = spark.createDataFrame([("r:0",)], "node string")
    return ops.reachable(g_edges(spark, sf_dir), start)


@query(f"WITH RECURSIVE {G}, t(node) AS (SELECT 'p:1' UNION SELECT g.src FROM g JOIN t ON g.dst = t.node) SELECT node FROM t")
def reachable_backward(spark, sf_dir):
    return ops.reachable(g_edges(spark, sf_dir), spark.createDataFrame([("p:1",)], "node string"), forward=False)


@query(f"WITH {G} SELECT dst AS node FROM g WHERE src = 'n:1' GROUP BY dst")
def successors(spark, sf_dir):
    return ops.neighbours(g_edges(spark, sf_dir), "n:1")


@query(f"WITH {G} SELECT src AS node FROM g WHERE dst = 'p:7' AND kind IN ('def_use') GROUP BY src")
def predecessors(spark, sf_dir):
    return ops.neighbours(g_edges(spark, sf_dir), "p:7", ["def_use"], forward=False)


@query(f"WITH {G} SELECT src, kind, count(*) AS degree, CAST(count(DISTINCT dst) AS BIGINT) AS targets FROM g GROUP BY src, kind")
def edge_outgoing(spark, sf_dir):
    return g_edges(spark, sf_dir).groupBy("src", "kind").agg(F.count("*").alias("degree"), F.countDistinct("dst").alias("targets"))


@query("SELECT 'h:' || l_orderkey AS edge_id, 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem GROUP BY ALL")
def hyperedge_pairs(spark, sf_dir):
    return ops.hyperedge_pairs(hyper(spark, sf_dir), ["edge_id"])


@query(f"""WITH {G}, one AS (SELECT DISTINCT src AS node FROM g WHERE dst = 'p:3'), two AS (SELECT DISTINCT src AS node FROM g WHERE dst IN (SELECT node FROM one))
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT 'p:3' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node""")
def bounded_callers(spark, sf_dir):
    return ops.hops(g_edges(spark, sf_dir), spark.createDataFrame([("p:3",)], "node string"), forward=False, most=2)


@query(f"WITH RECURSIVE {G}, t(node, hops) AS (SELECT 'r:1', 0 UNION SELECT g.dst, t.hops + 1 FROM g JOIN t ON g.src = t.node) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM t GROUP BY node")
def shortest_hops(spark, sf_dir):
    return ops.hops(g_edges(spark, sf_dir), spark.createDataFrame([("r:1",)], "node string"))


@query(f"WITH RECURSIVE {G}, t(node) AS (SELECT 'r:0' UNION SELECT g.dst FROM g JOIN t ON g.src = t.node WHERE g.dst NOT IN ('n:0', 'n:5')) SELECT node FROM t")
def bypass_forbidden(spark, sf_dir):
    return ops.reachable(g_edges(spark, sf_dir), spark.createDataFrame([("r:0",)], "node string"), forbidden=["n:0", "n:5"])


@query(f"""WITH {G}, up AS (SELECT a.dst AS node, a.src AS nation FROM g a WHERE a.kind = 'containment' AND a.src LIKE 'n:%'),
orders_of AS (SELECT up.nation, g.dst AS node FROM up JOIN g ON g.src = up.node), parts_of AS (SELECT DISTINCT o.nation, g.dst AS node FROM orders_of o JOIN g ON g.src = o.node)
SELECT nation, count(*) AS cone FROM (SELECT nation, node FROM up UNION SELECT nation, node FROM orders_of UNION SELECT nation, node FROM parts_of) GROUP BY nation""")
def impact_cone_sizes(spark, sf_dir):
    """Per nation: how many customers, orders and parts its cone holds."""
    e = g_edges(spark, sf_dir)
    step = lambda rows: rows.join(e.select(F.col("src").alias("node"), "dst"), "node").select("nation", F.col("dst").alias("node")).distinct()
    customers = e.where("src like 'n:%' and kind = 'containment'").select(F.col("src").alias("nation"), F.col("dst").alias("node"))
    orders = step(customers)
    return customers.union(orders).union(step(orders)).distinct().groupBy("nation").agg(F.count("*").alias("cone"))


@query(f"""WITH RECURSIVE {SCC}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT x.a AS node, least(min(x.b), x.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def scc_components(spark, sf_dir):
    """Nodes on a cycle, with the least node of their component."""
    e = scc_edges(spark, sf_dir)
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop")).distinct()
    return ops.strong_components(e).join(loops, "node", "left").where("size > 1 or loop").select("node", "component")


@query(f"""WITH RECURSIVE {SCC}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT a AS node, min(b) AS component FROM r GROUP BY a""")
def connected_components(spark, sf_dir):
    return ops.connected_components(scc_edges(spark, sf_dir))


@query(f"""WITH {G} SELECT o.src AS node, round(exp(sum(ln(greatest(i.confidence, 1e-9)))), 6) AS confidence FROM g o JOIN g i ON i.src = o.dst WHERE o.kind = 'triggers' GROUP BY o.src""")
def path_confidence(spark, sf_dir):
    """Product of the confidences two steps from every customer."""
    e = g_edges(spark, sf_dir)
    asked = e.where("kind = 'triggers'").select(F.col("src").alias("node"), F.col("dst").alias("mid"))
    rows = asked.join(e.select(F.col("src").alias("mid"), "confidence"), "mid")
    return ops.path_confidence(rows, ["node"], "confidence").select("node", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {G}, cover AS (SELECT DISTINCT src AS node, dst AS unit FROM g WHERE kind = 'def_use'),
blast AS (SELECT node, count(*) AS coverage FROM cover GROUP BY node), degree AS (SELECT dst AS unit, count(*) AS uses FROM g GROUP BY dst)
SELECT node, round(CAST(10.0 * coverage - 0.05 * sum(uses) AS DOUBLE), 4) AS score FROM cover JOIN blast USING (node) JOIN degree USING (unit) GROUP BY node, coverage""")
def causal_cut_rank(spark, sf_dir):
    """Suppliers as cut candidates: what they cover, less what the cut would touch."""
    e = g_edges(spark, sf_dir)
    cover = e.where("kind = 'def_use'").select(F.col("src").alias("node"), F.col("dst").alias("unit")).distinct()
    degree = e.groupBy(F.col("dst").alias("unit")).agg(F.count("*").alias("uses"))
    sums = cover.join(degree, "unit").groupBy("node").agg(F.count("*").alias("coverage"), F.sum("uses").alias("uses"))
    return sums.select("node", F.round(10.0 * F.col("coverage") - 0.05 * F.col("uses"), 4).alias("score"))


_COVER = f"WITH {G}, cover AS (SELECT DISTINCT src AS node, dst AS unit FROM g WHERE kind = 'def_use')"


@query(f"{_COVER} SELECT CAST(1 AS INTEGER) AS round, node, count(*) AS gain FROM cover GROUP BY node ORDER BY gain DESC, node LIMIT 1")
def set_cover_round1(spark, sf_dir):
    cover = g_edges(spark, sf_dir).where("kind = 'def_use'").select(F.col("src").alias("node"), F.col("dst").alias("unit"))
    return ops.set_cover(cover, most=1)


@query()
def set_cover(spark, sf_dir):
    """The greedy cover of parts by suppliers, until no part is left."""
    cover = g_edges(spark, sf_dir).where("kind = 'def_use'").select(F.col("src").alias("node"), F.col("dst").alias("unit"))
    return ops.set_cover(cover)


@query("""SELECT p_partkey AS part, p_retailprice AS price, p_size AS size FROM part p WHERE NOT EXISTS (
  SELECT 1 FROM part q WHERE q.p_retailprice <= p.p_retailprice AND q.p_size >= p.p_size AND (q.p_retailprice < p.p_retailprice OR q.p_size > p.p_size))""")
def pareto_skyline(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return ops.skyline(rows, "part", "price", "size")


@query(f"""WITH {G}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY node) SELECT node, degree FROM d WHERE degree > 100""")
def hub_nodes(spark, sf_dir):
    e = g_edges(spark, sf_dir)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("degree")).where("degree > 100")


@query(f"WITH {G} SELECT DISTINCT dst AS node FROM g WHERE dst NOT IN (SELECT src FROM g)")
def terminal_nodes(spark, sf_dir):
    e = g_edges(spark, sf_dir)
    return e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti")


@query(f"WITH {G} SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, round(min(confidence), 4) AS least FROM g GROUP BY kind")
def edge_kinds(spark, sf_dir):
    return g_edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.round(F.min("confidence"), 4).alias("least"))


@query(f"WITH {G}, n AS (SELECT 'o:' || o_orderkey AS node FROM orders) SELECT src, dst FROM g WHERE kind = 'triggers' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE 'o:' || l_orderkey = dst)")
def dangling_edges(spark, sf_dir):
    """Orders that nothing refers to: a referential audit by anti-join."""
    held = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("dst"))
    return g_edges(spark, sf_dir).where("kind = 'triggers'").join(held, "dst", "left_anti").select("src", "dst")
