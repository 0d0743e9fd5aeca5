"""Queries over requirements: a customer is a graph, its orders are leaves, their lineitems are path obligations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requirements as rq
from .views import Registry, View, cases, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

LEAVES = View("leaves", "orders", graph="o_custkey", leaf="o_orderkey", weight="CAST(1 + o_orderkey % 3 AS DOUBLE)", mandatory="o_orderkey % 4 <> 0", authority=cases("o_orderkey", "A", "B", "PROVISIONAL", "C"), authority_class=cases("o_custkey", "HARD", "DERIVED", "HYPOTHESIS", "PRESERVATION"))
LINES = View("lines", "lineitem", leaf="l_orderkey", obligation="concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING))", part="l_partkey", line="l_linenumber", flag="l_returnflag")
_OBLIGATIONS = "obligations AS (SELECT graph, leaf, obligation, min(part) % 5 <> 0 AS feasible, min(part) AS part FROM lines JOIN leaves USING (leaf) GROUP BY ALL)"


def _leaves(spark, sf_dir):
    return LEAVES.frame(spark, sf_dir)


def _obligations(spark, sf_dir):
    """Line numbers come twice now and then; the least part stands for them."""
    rows = LINES.frame(spark, sf_dir).join(_leaves(spark, sf_dir).select("graph", "leaf"), "leaf")
    return rows.groupBy("graph", "leaf", "obligation").agg(F.min("part").alias("part")).withColumn("feasible", F.col("part") % 5 != 0)


@query(cte(LEAVES, LINES) + f", {_OBLIGATIONS} SELECT obligation, leaf FROM obligations WHERE feasible")
def feasible_path_obligations(spark, sf_dir):
    return rq.feasible_obligations(_obligations(spark, sf_dir)).select("obligation", "leaf")


@query(cte(LEAVES) + " SELECT graph, leaf FROM leaves WHERE mandatory")
def mandatory_leaves(spark, sf_dir):
    return rq.mandatory_leaves(_leaves(spark, sf_dir)).select("graph", "leaf")


@query(cte(LEAVES) + ", p AS (SELECT graph, leaf, authority_class AS part FROM leaves UNION ALL SELECT graph, leaf, 'PROVISIONAL' FROM leaves WHERE authority = 'PROVISIONAL') SELECT graph, part, array_to_string(list_sort(list(leaf)), ',') AS leaves FROM p GROUP BY graph, part")
def authority_partition(spark, sf_dir):
    return rq.partition_leaves(_leaves(spark, sf_dir)).withColumn("leaves", F.array_join(F.col("leaves").cast("array<string>"), ","))


CHANGES = View("changes", "orders", leaf="o_orderkey + 1", authority=cases("o_custkey", "A", "PROVISIONAL", "C"), authority_class=cases("o_orderkey", "HARD", "HYPOTHESIS", "PRESERVATION", "OTHER"))


@query(cte(LEAVES, LINES, CHANGES) + """ SELECT leaf, c.authority, c.authority_class, c.authority <> 'PROVISIONAL' AND c.authority_class <> 'OTHER' AS mandatory, 'AUTHORITY_CHANGED_RECOMPILE_REQUIRED' AS coverage_status, coalesce(ids, '') AS invalidated
FROM changes c SEMI JOIN leaves USING (leaf) LEFT JOIN (SELECT leaf, array_to_string(list_sort(list(DISTINCT obligation)), ',') AS ids FROM lines GROUP BY leaf) o USING (leaf)""")
def authority_change(spark, sf_dir):
    out = rq.apply_authority(_leaves(spark, sf_dir), CHANGES.frame(spark, sf_dir), _obligations(spark, sf_dir).select("obligation", "leaf"))
    return out.withColumn("invalidated", F.array_join("invalidated", ","))


PROOFS = View("proofs", "part", id="p_partkey", satisfiable="p_partkey % 3 = 0", complete="p_size % 2 = 0", reason=cases("p_partkey", "finite_domain_exhausted", "unsupported_constraint", "unsupported_constraint:Call", "open_world_unresolved", "missing_domain"))


@query(cte(PROOFS) + " SELECT id, NOT satisfiable AND complete AND reason IN ('finite_domain_exhausted', 'unsupported_constraint', 'missing_domain') AS proven FROM proofs")
def proven_unsat(spark, sf_dir):
    return PROOFS.frame(spark, sf_dir).select("id", rq.is_proven_unsat(F.col("satisfiable"), F.col("complete"), F.col("reason")).alias("proven"))


LEDGER = View("ledger", "orders", graph="o_custkey", ledger="o_orderkey", status=cases("o_orderkey", "ENUMERATED", "PROVED_INFEASIBLE", "PRESERVATION_ONLY", "ENUMERATED", "ENUMERATED", "ENUMERATED", "OPEN"))
FRONTIERS = View("frontiers", "orders", graph="o_custkey", frontier="o_orderkey", owner="o_orderkey + o_custkey % 2", hard="o_orderpriority = '1-URGENT'", status="CASE WHEN o_orderkey % 8 = 0 THEN 'OPEN' ELSE 'CLOSED' END")
_TEXT = lambda c, n: f"coalesce(array_to_string(list_sort({c}), ','), '') AS {n}"


@query(cte(LEAVES, LINES, LEDGER, FRONTIERS) + f""", {_OBLIGATIONS},
num AS (SELECT graph, sum(weight) AS n FROM obligations JOIN leaves USING (graph, leaf) WHERE feasible GROUP BY graph),
owed AS (SELECT f.graph, sum(coalesce(weight, 1)) AS n FROM frontiers f LEFT JOIN leaves l ON l.graph = f.graph AND l.leaf = f.owner WHERE status = 'OPEN' GROUP BY f.graph),
miss AS (SELECT graph, list(leaf) AS ids FROM leaves ANTI JOIN (SELECT graph, leaf FROM obligations WHERE feasible) USING (graph, leaf) WHERE mandatory GROUP BY graph),
rest AS (SELECT graph, list(ledger) AS ids FROM ledger WHERE status = 'OPEN' GROUP BY graph), hard AS (SELECT graph, list(frontier) AS ids FROM frontiers WHERE hard AND status = 'OPEN' GROUP BY graph), have AS (SELECT DISTINCT graph FROM obligations)
SELECT g.graph, have.graph IS NOT NULL AND miss.ids IS NULL AND rest.ids IS NULL AND hard.ids IS NULL AS closed, round(CASE WHEN coalesce(num.n, 0) + coalesce(owed.n, 0) > 0 THEN coalesce(num.n, 0) / (coalesce(num.n, 0) + coalesce(owed.n, 0)) ELSE 0 END, 9) AS coverage,
  {_TEXT('miss.ids', 'missing')}, {_TEXT('rest.ids', 'nonterminal')}, {_TEXT('hard.ids', 'frontiers')}
FROM (SELECT DISTINCT graph FROM leaves) g LEFT JOIN num USING (graph) LEFT JOIN owed USING (graph) LEFT JOIN miss USING (graph) LEFT JOIN rest USING (graph) LEFT JOIN hard USING (graph) LEFT JOIN have USING (graph)""")
def requirement_path_closure(spark, sf_dir):
    out = rq.path_closure(_leaves(spark, sf_dir), _obligations(spark, sf_dir), LEDGER.frame(spark, sf_dir), FRONTIERS.frame(spark, sf_dir))
    return _joined(out, ["missing", "nonterminal", "frontiers"]).withColumn("coverage", F.round("coverage", 9))


def _joined(df, lists):
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in lists else c for c in df.columns])


UNITS = View("units", "lineitem", leaf="l_orderkey", obligation="concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING))", unit="l_partkey", status=cases("l_partkey", "READY", "READY", "BLOCKED", "READY"), requirement_hash="CASE WHEN l_suppkey % 9 = 0 THEN 'old' ELSE 'now' END", program_hash="'p'", bound="l_partkey % 11 <> 0")
GRAPHS = View("graphs", "customer", graph="c_custkey", requirement_hash="'now'", program_hash="'p'")


@query(cte(LEAVES, LINES, FRONTIERS, UNITS, GRAPHS) + f""", {_OBLIGATIONS}, u AS (SELECT l.graph, units.* FROM units JOIN leaves l USING (leaf) WHERE bound), n AS (SELECT graph, obligation, count(*) AS n FROM u GROUP BY ALL),
k AS (SELECT o.graph, o.obligation, n FROM obligations o LEFT JOIN n USING (graph, obligation) WHERE feasible),
miss AS (SELECT graph, list(obligation) AS ids FROM k WHERE n IS NULL GROUP BY graph), dup AS (SELECT graph, list(obligation) AS ids FROM k WHERE n > 1 GROUP BY graph), stale AS (SELECT graph, list(unit) AS ids FROM u WHERE requirement_hash = 'old' GROUP BY graph),
blocked AS (SELECT graph, list(unit) AS ids FROM u WHERE status = 'BLOCKED' GROUP BY graph), hard AS (SELECT graph, list(frontier) AS ids FROM frontiers WHERE hard AND status = 'OPEN' GROUP BY graph),
ready AS (SELECT u.graph, sum(weight) AS n FROM u JOIN leaves l ON l.graph = u.graph AND l.leaf = u.leaf WHERE status = 'READY' GROUP BY u.graph), total AS (SELECT graph, sum(weight) AS n FROM obligations JOIN leaves USING (graph, leaf) WHERE feasible GROUP BY graph)
SELECT g.graph, miss.ids IS NULL AND dup.ids IS NULL AND stale.ids IS NULL AND blocked.ids IS NULL AND hard.ids IS NULL AS closed,
  round(CASE WHEN coalesce(total.n, 0) + coalesce(len(hard.ids), 0) > 0 THEN coalesce(ready.n, 0) / (coalesce(total.n, 0) + coalesce(len(hard.ids), 0)) WHEN total.n IS NULL THEN 1 ELSE 0 END, 9) AS ready_ratio,
  {_TEXT('miss.ids', 'missing')}, {_TEXT('dup.ids', 'duplicates')}, {_TEXT('stale.ids', 'stale')}, {_TEXT('blocked.ids', 'blocked')}, {_TEXT('hard.ids', 'frontiers')}
FROM graphs g LEFT JOIN miss USING (graph) LEFT JOIN dup USING (graph) LEFT JOIN stale USING (graph) LEFT JOIN blocked USING (graph) LEFT JOIN hard USING (graph) LEFT JOIN ready USING (graph) LEFT JOIN total USING (graph)""")
def binding_path_closure(spark, sf_dir):
    leaves = _leaves(spark, sf_dir)
    units = UNITS.frame(spark, sf_dir).where("bound").join(leaves.select("graph", "leaf"), "leaf")
    out = rq.binding_closure(leaves, _obligations(spark, sf_dir), units, FRONTIERS.frame(spark, sf_dir), GRAPHS.frame(spark, sf_dir))
    return _joined(out, ["missing", "duplicates", "stale", "blocked", "frontiers"]).withColumn("ready_ratio", F.round("ready_ratio", 9))


PATHS = View("paths", "lineitem", leaf="l_orderkey", path="l_partkey * 10 + l_linenumber", feasible="l_partkey % 9 <> 0", exit=cases("l_suppkey", "return", "raise", "return", "exception"), guard=cases("l_partkey", "x > 1", "y == 2", "x > 1"), name=cases("l_partkey", "x", "y", "x"), watched=cases("l_linenumber", "o1", "o2"), n_edges="l_partkey % 17")
PARTS = View("parts", "lineitem", leaf="l_orderkey", partition="concat('p', CAST(l_suppkey AS STRING))", satisfiable="l_suppkey % 4 <> 0", name=cases("l_suppkey", "x", "z", "w", "v", "x"), constraint_text="CASE WHEN l_suppkey % 6 = 0 THEN 'True' ELSE 'x > 0' END")
LEAF_CHANNELS = View("leaf_channels", "orders", leaf="o_orderkey", channel=cases("o_orderkey", "return", "exception", "state"))


@query(cte(PATHS, PARTS, LEAF_CHANNELS) + """,
u AS (SELECT DISTINCT p.*, channel FROM paths p JOIN leaf_channels USING (leaf) WHERE feasible AND CASE channel WHEN 'exception' THEN exit <> 'return' WHEN 'return' THEN exit = 'return' ELSE true END),
g AS (SELECT DISTINCT leaf, partition, name, constraint_text FROM parts WHERE satisfiable),
l AS (SELECT DISTINCT u.leaf, path, partition FROM u JOIN g ON u.leaf = g.leaf AND u.name = g.name),
one AS (SELECT leaf, arg_min(partition, (constraint_text <> 'True', partition)) AS partition FROM g GROUP BY leaf),
a AS (SELECT * FROM l UNION ALL SELECT DISTINCT u.leaf, u.path, one.partition FROM u JOIN one USING (leaf) WHERE (u.leaf, u.path) NOT IN (SELECT leaf, path FROM l)),
k AS (SELECT DISTINCT a.*, guard, exit, watched, n_edges FROM a JOIN u USING (leaf, path)),
f AS (SELECT leaf, path, partition, n_edges FROM k QUALIFY row_number() OVER (PARTITION BY leaf, guard, exit, watched ORDER BY n_edges, path, partition) = 1)
SELECT leaf, path, partition, n_edges, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY leaf ORDER BY n_edges, path) AS INTEGER) AS place FROM f) WHERE place <= 4""")
def requirement_paths(spark, sf_dir):
    """The four shortest paths of each leaf are the report."""
    paths = PATHS.frame(spark, sf_dir).distinct().withColumn("names", F.array("name")).withColumn("observations", F.array("watched"))
    parts = PARTS.frame(spark, sf_dir).distinct().withColumn("names", F.array("name")).withColumn("constraints", F.array("constraint_text"))
    leaves = LEAF_CHANNELS.frame(spark, sf_dir).select("leaf", F.array("channel").alias("channels"))
    return rq.requirement_paths(leaves, paths, parts, 4)


REQUIREMENTS = View("reqs", "orders", requirement="o_orderkey", check_id="concat('c', CAST(o_custkey AS STRING))", execution="o_orderkey", status="CASE o_orderstatus WHEN 'F' THEN 'BASELINE_FAILING_TARGET' ELSE 'PASSING' END", resolved="o_orderkey % 5 <> 0")
SLICES = View("slices", "lineitem", execution="l_orderkey", cut="l_partkey", has="l_suppkey % 3 <> 0")


@query(cte(REQUIREMENTS, SLICES) + """, s AS (SELECT execution, list_sort(list(DISTINCT cut))[1:20] AS cuts FROM slices WHERE has GROUP BY execution)
SELECT requirement, CASE status WHEN 'PASSING' THEN 'EXECUTABLE_PRESERVATION' ELSE 'EXECUTABLE_TARGET' END AS kind, check_id, s.execution AS slice, coalesce(array_to_string(cuts, ','), '') AS cuts, CASE WHEN cuts IS NOT NULL THEN 'CUT_RESOLVED' WHEN status = 'PASSING' THEN 'NOT_REQUIRED' ELSE 'CUT_UNRESOLVED' END AS cut_status
FROM reqs LEFT JOIN s USING (execution) WHERE resolved UNION ALL SELECT requirement, 'DEFERRED_NORMATIVE', NULL, NULL, '', 'NOT_EVALUABLE' FROM reqs WHERE NOT resolved""")
def executable_bindings(spark, sf_dir):
    r = REQUIREMENTS.frame(spark, sf_dir)
    s = SLICES.frame(spark, sf_dir).where("has").groupBy("execution").agg(F.array_sort(F.collect_set("cut")).alias("cuts")).withColumn("slice", F.col("execution"))
    return _joined(rq.executable_bindings(r.where("resolved"), s, r.where("not resolved")), ["cuts"])


BINDS = View("binds", "part", id="p_partkey", t="p_partkey % 2 = 0", d="p_partkey % 3 <> 0", o="p_partkey % 5 <> 0", active="p_size % 4 <> 0", channel=cases("p_size", "return", "state", "calls"), wanted=cases("p_partkey", "return", "state"))


@query(cte(BINDS) + """, x AS (SELECT *, active AND channel = wanted AS a FROM binds), y AS (SELECT id, a, array_to_string(list_filter([CASE WHEN NOT t THEN 'trigger' END, CASE WHEN NOT d THEN 'domain_guard' END, CASE WHEN NOT o THEN 'observation' END, CASE WHEN NOT a THEN 'oracle' END], lambda z: z IS NOT NULL), ';') AS lacks FROM x)
SELECT id, a AS applicable, lacks = '' AS compatible, CASE WHEN lacks = '' THEN 'compatible' ELSE lacks END AS reason FROM y""")
def bind_compatibility(spark, sf_dir):
    fits = rq.oracle_applicable(F.col("active"), F.array("channel"), F.array("wanted"))["compatible"]
    out = rq.bind_compatibility(F.col("t"), F.col("d"), F.col("o"), fits)
    return BINDS.frame(spark, sf_dir).select("id", fits.alias("applicable"), out["compatible"].alias("compatible"), out["reason"].alias("reason"))


FILES = View("files", "part", id="p_partkey", path=cases("p_partkey", "pkg/api.py", "pkg/tests/a.py", "pkg/test_api.py", "Vendor/x.py", "pkg/api_test.py", "pkg/x.generated.py", "<string>", "pkg/migrations/0001.py"), kind=cases("p_size", "function", "test", "branch", "module", "field"), in_tests="p_partkey % 10 = 0")


@query(cte(FILES) + """ SELECT id, kind IN ('function', 'branch', 'field') AND NOT in_tests AND path NOT IN ('<string>', 'pkg/tests/a.py') AND path NOT LIKE '%/api.py' AS modifiable, path IN ('pkg/tests/a.py', 'pkg/test_api.py', 'Vendor/x.py', 'pkg/api_test.py', 'pkg/x.generated.py', 'pkg/migrations/0001.py') AS excluded FROM files""")
def modifiable_nodes(spark, sf_dir):
    f = FILES.frame(spark, sf_dir)
    return f.select("id", rq.is_modifiable(F.col("kind"), F.col("path"), F.col("in_tests"), ["function", "branch", "field"], ["/api\\.py$"]).alias("modifiable"), rq.is_excluded(F.col("path")).alias("excluded"))
