"""Queries over bindings and reports: orders are units or runs, lineitems their nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bindings as bd
from .views import Registry, View, cases, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

UNITS = View("units", "orders", graph="o_custkey", unit="o_orderkey", status=cases("o_orderkey", "PASSING", "FAILING", "UNKNOWN", "BOUND_STATIC", "UNBOUND", "PRESERVATION_RISK", "OTHER", "ENVIRONMENT_BLOCKED"))
UNIT_NODES = View("unit_nodes", "lineitem", unit="l_orderkey", node="l_partkey", relation=cases("l_linenumber", "repair_cut", "state", "preservation", "other", "dispatch"))
NODES = View("nodes", "part", node="p_partkey", label=cases("p_partkey", "Helper", "run", "logger"), degree="p_size * 4", kind=cases("p_size", "return", "field", "branch", "exception", "call_site", "external_effect"), file="p_brand", name="concat('pkg.', p_type)")
_RANK = "CASE status WHEN 'FAILING' THEN 0 WHEN 'PRESERVATION_RISK' THEN 1 WHEN 'UNBOUND' THEN 3 WHEN 'UNKNOWN' THEN 4 WHEN 'ENVIRONMENT_BLOCKED' THEN 6 WHEN 'BOUND_STATIC' THEN 8 ELSE 99 END"


@query(cte(UNITS) + f" SELECT graph, unit, status, CAST(row_number() OVER (PARTITION BY graph ORDER BY {_RANK}, unit) AS INTEGER) AS place FROM units WHERE status <> 'PASSING'")
def relevant_units(spark, sf_dir):
    return bd.relevant_units(UNITS.frame(spark, sf_dir))


@query(cte(UNIT_NODES, NODES) + " SELECT DISTINCT unit FROM unit_nodes SEMI JOIN (SELECT node FROM nodes WHERE kind = 'exception') USING (node)")
def units_of_nodes(spark, sf_dir):
    return bd.units_of_nodes(UNIT_NODES.frame(spark, sf_dir), NODES.frame(spark, sf_dir).where("kind = 'exception'"))


RELATIONS = View("relations", "supplier", relation="s_suppkey", file="concat('Brand#', CAST(1 + s_suppkey % 5 AS STRING), CAST(1 + s_nationkey % 5 AS STRING))", scope=cases("s_suppkey", "<module>", "ST", "nothing", "PROMO", "pkg."))


@query(cte(RELATIONS, UNIT_NODES, NODES) + """, spots AS (SELECT DISTINCT file, name, unit FROM nodes JOIN unit_nodes USING (node) WHERE kind = 'branch')
SELECT DISTINCT relation, unit FROM relations JOIN spots USING (file) WHERE scope = '<module>' OR contains(name, scope)""")
def candidate_units(spark, sf_dir):
    return bd.candidate_units(RELATIONS.frame(spark, sf_dir), NODES.frame(spark, sf_dir).where("kind = 'branch'"), UNIT_NODES.frame(spark, sf_dir))[0]


@query(cte(RELATIONS, UNIT_NODES, NODES) + """, spots AS (SELECT DISTINCT file, name, unit FROM nodes JOIN unit_nodes USING (node) WHERE kind = 'branch')
SELECT relation FROM relations WHERE relation NOT IN (SELECT relation FROM relations JOIN spots USING (file) WHERE scope = '<module>' OR contains(name, scope))""")
def relations_without_units(spark, sf_dir):
    return bd.candidate_units(RELATIONS.frame(spark, sf_dir), NODES.frame(spark, sf_dir).where("kind = 'branch'"), UNIT_NODES.frame(spark, sf_dir))[1]


BEFORE = View("before", "orders", obligation="o_orderkey", unit="concat('u', CAST(o_orderkey AS STRING))", has="o_orderkey % 7 <> 0")
AFTER = View("after", "orders", obligation="o_orderkey", unit="concat('u', CAST(o_orderkey AS STRING), '+')", has="o_orderkey % 5 <> 0", impacted="o_orderstatus = 'P'")


@query(cte(BEFORE, AFTER) + """, b AS (SELECT * FROM before WHERE has), a AS (SELECT * FROM after WHERE has), i AS (SELECT obligation FROM after WHERE impacted)
SELECT unit, 'invalidated' AS change FROM b SEMI JOIN i USING (obligation) UNION ALL SELECT unit, 'rebound' FROM a SEMI JOIN i USING (obligation) UNION ALL SELECT unit, 'added' FROM a ANTI JOIN b USING (obligation) UNION ALL SELECT unit, 'removed' FROM b ANTI JOIN a USING (obligation)""")
def incremental_rebind(spark, sf_dir):
    b, a = BEFORE.frame(spark, sf_dir).where("has"), AFTER.frame(spark, sf_dir)
    return bd.rebind(b, a.where("has"), a.where("impacted"))


NEEDS = View("needs", "lineitem", obligation="l_orderkey", id="CASE l_linenumber % 2 WHEN 0 THEN l_partkey ELSE l_suppkey END", is_edge="l_linenumber % 2 = 1")
HAVE = View("have", "orders", obligation="o_orderkey", has_path="o_orderkey % 6 <> 0")
STANDING_NODES = View("standing_nodes", "part", id="p_partkey", stands="p_size <> 17")
STANDING_EDGES = View("standing_edges", "supplier", id="s_suppkey", stands="s_suppkey % 10 <> 3")


@query(cte(NEEDS, HAVE, STANDING_NODES, STANDING_EDGES) + """ SELECT obligation, has_path AND obligation NOT IN (SELECT obligation FROM needs WHERE (NOT is_edge AND id NOT IN (SELECT id FROM standing_nodes WHERE stands)) OR (is_edge AND id NOT IN (SELECT id FROM standing_edges WHERE stands))) AS current FROM have""")
def obligation_references(spark, sf_dir):
    f = lambda v: v.frame(spark, sf_dir)
    return bd.references_current(f(HAVE), f(NEEDS), f(STANDING_NODES).where("stands"), f(STANDING_EDGES).where("stands"))


CORE_NODES = View("core_nodes", "lineitem", unit="l_suppkey", node="l_partkey", relation=cases("l_linenumber", "repair_cut", "state", "preservation", "other", "dispatch"), live="l_quantity > 49")


@query("WITH RECURSIVE " + cte(CORE_NODES, NODES).removeprefix("WITH ") + """, live AS (SELECT DISTINCT unit, node, relation FROM core_nodes SEMI JOIN (SELECT node FROM nodes WHERE NOT (degree > 100 AND label IN ('Helper', 'logger'))) USING (node) WHERE live AND relation <> 'other'),
e AS (SELECT DISTINCT a.unit AS x, b.unit AS y FROM live a JOIN live b ON a.node = b.node AND a.relation = b.relation),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS unit, min(y) AS component FROM r GROUP BY x""")
def repair_components(spark, sf_dir):
    return bd.repair_components(CORE_NODES.frame(spark, sf_dir).where("live"), NODES.frame(spark, sf_dir))


PAIRS = View("pairs", "lineitem", unit="l_orderkey", role=cases("l_linenumber", "TARGET", "PRESERVATION", "TARGET"), **{"class": "CASE WHEN l_partkey % 13 = 0 THEN 'PRESERVATION_REGRESSION' WHEN l_partkey % 11 = 0 THEN 'TARGET_STILL_FAILING' WHEN l_partkey % 3 = 0 THEN 'PASS_PRESERVED' ELSE 'TARGET_FIXED' END"}, baseline="CASE WHEN l_partkey % 13 = 0 THEN 'PASS' WHEN l_partkey % 17 = 0 THEN 'TIMEOUT' ELSE 'FAIL' END", patched=cases("l_suppkey", "FAIL", "FAIL", "PASS"), baseline_stable="l_suppkey % 5 <> 0", patched_stable="l_partkey % 19 <> 0")


@query(cte(PAIRS) + """, k AS (SELECT * FROM pairs WHERE baseline <> 'TIMEOUT' AND baseline_stable AND patched_stable)
SELECT unit, CASE WHEN bool_or(class = 'PRESERVATION_REGRESSION' AND baseline = 'PASS' AND patched = 'FAIL') THEN 'PRESERVATION_RISK' WHEN bool_or(class = 'TARGET_STILL_FAILING' AND baseline = 'FAIL' AND patched = 'FAIL') THEN 'FAILING'
  WHEN (count(*) FILTER (role = 'TARGET') > 0 AND bool_and(role <> 'TARGET' OR class = 'TARGET_FIXED')) OR bool_and(class = 'PASS_PRESERVED') THEN 'PASSING' ELSE 'UNKNOWN' END AS status FROM k GROUP BY unit""")
def comparison_status(spark, sf_dir):
    return bd.comparison_status(PAIRS.frame(spark, sf_dir))


@query(cte(NODES) + """ SELECT node, CASE kind WHEN 'return' THEN 'return' WHEN 'field' THEN 'state' WHEN 'exception' THEN 'exception' WHEN 'call_site' THEN 'calls' WHEN 'external_effect' THEN 'output,effects' ELSE '' END AS channels FROM nodes""")
def project_observation(spark, sf_dir):
    every = F.array(*[F.lit(c) for c in bd.CHANNEL_KINDS])
    return NODES.frame(spark, sf_dir).select("node", F.array_join(bd.project_observation(F.col("kind"), every), ",").alias("channels"))


SYMBOLS = View("symbols", "lineitem", unit="l_orderkey", file="concat('f', CAST(l_partkey % 40 AS STRING))", name="concat('pkg.m', CAST(l_suppkey AS STRING), '.g', CAST(l_partkey % 6 AS STRING))")
SCOPES = View("scopes", "supplier", scope="concat('m', CAST(s_suppkey AS STRING), '.g', CAST(s_nationkey % 6 AS STRING))", file="concat('f', CAST(s_suppkey * 7 % 40 AS STRING))")
HUNKS = View("hunks", "part", hunk="p_partkey", file="concat('f', CAST(p_partkey % 53 AS STRING))")


@query(cte(SYMBOLS, SCOPES, HUNKS) + """, f AS (SELECT unit, file FROM symbols UNION SELECT unit, scopes.file FROM symbols JOIN scopes ON name = scope OR ends_with(name, '.' || scope)) SELECT DISTINCT unit, hunk FROM f JOIN hunks USING (file)""")
def hunks_for_symbols(spark, sf_dir):
    return bd.hunks_for_symbols(*[v.frame(spark, sf_dir) for v in (SYMBOLS, SCOPES, HUNKS)])


PATH_NODES = View("path_nodes", "lineitem", path="l_orderkey", node="l_partkey")


@query(cte(UNIT_NODES, PATH_NODES) + """, h AS (SELECT DISTINCT u.unit, p.path FROM unit_nodes u JOIN path_nodes p USING (node)) SELECT unit, path, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY path) AS place FROM h) WHERE place <= 40""")
def path_projection(spark, sf_dir):
    return bd.path_projection(UNIT_NODES.frame(spark, sf_dir), PATH_NODES.frame(spark, sf_dir))


EDGES = View("edges", "lineitem", edge_id="concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING))", src="l_partkey", dst="l_suppkey + 1")


@query(cte(NODES, EDGES) + """, t AS (SELECT file, count(DISTINCT edge_id) AS n FROM (SELECT edge_id, src AS node FROM edges UNION ALL SELECT edge_id, dst FROM edges) JOIN nodes USING (node) GROUP BY file)
SELECT file, count(*) AS nodes, coalesce(any_value(t.n), 0) AS edges, count(*) FILTER (kind = 'call_site') AS functions FROM nodes LEFT JOIN t USING (file) GROUP BY file""")
def file_costs(spark, sf_dir):
    n = NODES.frame(spark, sf_dir)
    return bd.file_costs(n, EDGES.frame(spark, sf_dir), n.where("kind = 'call_site'").select("node"))


FRAMES = View("frames", "events", run="event_id", file="user_id", line="event_id")
SPANS = View("spans", "events", node="event_id", kind=cases("event_id", "call", "module", "branch"), file="user_id", line="event_id - event_id % 50", end_line="CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id + event_id % 120 END")


@query(cte(FRAMES, SPANS) + """ SELECT run, node, CAST(row_number() OVER (PARTITION BY run ORDER BY kind = 'module', coalesce(end_line, s.line) - s.line, node) AS INTEGER) AS place FROM frames f JOIN spans s ON f.file = s.file AND f.line BETWEEN s.line AND coalesce(s.end_line, s.line)""")
def enclosing_frames(spark, sf_dir):
    return bd.enclosing_frames(FRAMES.frame(spark, sf_dir), SPANS.frame(spark, sf_dir), ["call", "branch"])


CASES = View("cases", "customer", **{"case": "c_custkey"})
ORIGINS = View("origins", "orders", **{"case": "o_custkey"}, origin="CASE WHEN o_orderkey % 61 = 0 THEN 'PATCH_MECHANICAL' WHEN o_orderkey % 47 = 0 THEN 'PRESERVATION' ELSE 'TARGET_BEHAVIOR' END")
SLICED = View("sliced", "orders", **{"case": "o_custkey"}, kind="CASE WHEN o_orderkey % 43 = 0 THEN 'protocol_operation' WHEN o_orderkey % 29 = 0 THEN 'loop' WHEN o_orderkey % 23 = 0 THEN 'state_write' ELSE 'statement' END")
EXITS = View("exits", "orders", **{"case": "o_custkey"}, exit="CASE WHEN o_orderkey % 19 = 0 THEN 'exception' ELSE 'normal' END")


@query(cte(CASES, ORIGINS, SLICED, EXITS) + """, i AS (SELECT c.case, CASE WHEN c.case IN (SELECT o.case FROM origins o WHERE origin = 'PATCH_MECHANICAL') THEN 'mechanical_repair' WHEN c.case IN (SELECT o.case FROM origins o WHERE origin = 'PRESERVATION') THEN 'preservation_restore'
  WHEN c.case IN (SELECT s.case FROM sliced s WHERE kind = 'protocol_operation') THEN 'dispatch_protocol' WHEN c.case IN (SELECT s.case FROM sliced s WHERE kind = 'loop') THEN 'guard_boundary' WHEN c.case IN (SELECT s.case FROM sliced s WHERE kind = 'state_write') THEN 'state_order'
  WHEN c.case IN (SELECT e.case FROM exits e WHERE exit = 'exception') THEN 'exception_contract' ELSE 'return_relation' END AS mechanism FROM cases c) SELECT * FROM i""")
def diagnosed_mechanism(spark, sf_dir):
    return bd.diagnose(*[v.frame(spark, sf_dir) for v in (CASES, ORIGINS, SLICED, EXITS)])


@query(cte(UNIT_NODES, NODES) + """, k AS (SELECT unit, list(DISTINCT kind) AS kinds FROM unit_nodes JOIN nodes USING (node) GROUP BY unit)
SELECT unit, CASE WHEN list_contains(kinds, 'branch') THEN 'guard_boundary,' ELSE '' END || CASE WHEN list_contains(kinds, 'exception') THEN 'exception_contract,' ELSE '' END || CASE WHEN list_contains(kinds, 'field') THEN 'state_order,' ELSE '' END || 'return_relation,mechanism_rewrite' AS tries FROM k""")
def mechanism_candidates(spark, sf_dir):
    kinds = UNIT_NODES.frame(spark, sf_dir).join(NODES.frame(spark, sf_dir), "node").groupBy("unit").agg(F.collect_set("kind").alias("kinds"))
    return kinds.select("unit", F.array_join(bd.mechanism_candidates(F.col("kinds")), ",").alias("tries"))


BUILDS = View("builds", "orders", id="o_orderkey", nodes="o_orderkey % 100", edges="o_custkey % 100", expired="o_orderkey % 17 = 0", rss="o_custkey % 50")


@query(cte(BUILDS) + " SELECT id, CASE WHEN expired THEN 'DEADLINE' WHEN nodes >= 80 THEN 'NODE_LIMIT' WHEN edges >= 70 THEN 'EDGE_LIMIT' WHEN rss >= 40 THEN 'RSS_LIMIT' END AS stop FROM builds")
def graph_budget(spark, sf_dir):
    c = F.col
    return BUILDS.frame(spark, sf_dir).select("id", bd.within_budget(c("nodes"), c("edges"), c("expired"), c("rss"), F.lit(80), F.lit(70), F.lit(40)).alias("stop"))


RESULTS = View("results", "orders", id="o_orderkey", stage=cases("o_orderkey", "generation", "official_harness", "generation"), status=cases("o_custkey", "PASS", "REACHED", "SEMANTIC_BLOCKED", "NO_LEGAL_ACTION", "FAIL", "REVISION_BUDGET_EXHAUSTED_WITH_TARGET_FAILURE", "UNKNOWN"), phase=cases("o_orderkey", "", "CORE_SELECT", "SEALED", ""), running="CASE WHEN o_orderkey % 10 = 0 THEN 'binding' ELSE '' END", done=cases("o_custkey", "repository_index", "other", "first_patch_generation"), error="CASE WHEN o_orderkey % 9 = 0 THEN 'boom' ELSE '' END", target="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END", submitted="o_orderkey % 5")


@query(cte(RESULTS) + """ SELECT id, CASE WHEN stage = 'official_harness' THEN stage WHEN status = 'SEMANTIC_BLOCKED' THEN 'semantic_analysis' WHEN status = 'NO_LEGAL_ACTION' THEN 'repair_action_selection' WHEN phase = 'CORE_SELECT' THEN 'core_select' WHEN running <> '' THEN running WHEN done <> 'other' THEN done ELSE 'generation' END AS point,
  CASE WHEN error <> '' THEN error WHEN stage = 'official_harness' THEN 'official harness isolated result: target=' || coalesce(target, 'UNKNOWN') || ', preservation=UNKNOWN' WHEN status LIKE 'REVISION%' THEN 'revision budget exhausted before Reach: submitted=' || submitted || ', deferred_bindings=0, active_challenges=0, real_challenge_executions=0' ELSE 'no certified Reach transition was available' END AS reason
FROM results WHERE status <> 'PASS' AND NOT (stage = 'generation' AND status = 'REACHED')""")
def failure_report(spark, sf_dir):
    c = F.col
    listed = lambda x: F.filter(F.array(x), lambda v: v != "")
    point = bd.failure_point(c("stage"), c("status"), F.array("phase", F.lit("SEALED")), listed("running"), F.array("done"))
    counts = F.struct(c("submitted"), F.lit(None).cast("int").alias("deferred"), F.lit(0).alias("active"), F.lit(0).alias("real"))
    reason = bd.failure_reason(c("error"), c("stage"), c("status"), c("target"), F.lit(None).cast("string"), counts)
    return RESULTS.frame(spark, sf_dir).where(bd.is_failure(c("stage"), c("status"))).select("id", point.alias("point"), reason.alias("reason"))


LINEAGE = View("lineage", "customer", id="c_custkey", a=cases("c_custkey", "x", "y", ""), b="c_mktsegment", wanted_a="CASE WHEN c_nationkey % 2 = 0 THEN 'x' ELSE '' END", wanted_b="CASE WHEN c_custkey % 4 = 0 THEN 'BUILDING' ELSE c_mktsegment END")


@query(cte(LINEAGE) + " SELECT id, a = wanted_a AND b = wanted_b AS matches FROM lineage")
def lineage_matches(spark, sf_dir):
    c = F.col
    has = F.when(c("a") == "", F.create_map(F.lit("b"), c("b"))).otherwise(F.create_map(F.lit("a"), c("a"), F.lit("b"), c("b")))
    return LINEAGE.frame(spark, sf_dir).select("id", bd.lineage_matches(has, F.create_map(F.lit("a"), c("wanted_a"), F.lit("b"), c("wanted_b"))).alias("matches"))


CHOICES = View("choices", "lineitem", assignment="l_orderkey", claim="CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END")
CLAIMS = View("claims", "part", claim="p_partkey", authority=cases("p_size", "A", "B", "PROVISIONAL", "C"), cluster="p_brand")
_SCORED = """, s AS (SELECT assignment, sum(CASE WHEN c.claim IS NULL THEN -1 WHEN authority = 'A' THEN 5 WHEN authority = 'B' THEN 3 WHEN authority = 'C' THEN 2 ELSE 0.5 END) AS base, count(DISTINCT cluster) AS n, list_sort(list(DISTINCT cluster) FILTER (cluster IS NOT NULL)) AS clusters, count(*) FILTER (authority IN ('A', 'B', 'C')) AS explicit FROM choices c LEFT JOIN claims USING (claim) GROUP BY assignment),
t AS (SELECT assignment, CAST(base + 0.25 * n AS DOUBLE) AS score, coalesce(clusters, []) AS clusters, explicit FROM s)"""


@query(cte(CHOICES, CLAIMS) + _SCORED + " SELECT assignment, score FROM t")
def assignment_scores(spark, sf_dir):
    claims = CLAIMS.frame(spark, sf_dir)
    return bd.assignment_scores(CHOICES.frame(spark, sf_dir), claims.select("claim", "authority"), claims.select("claim", "cluster"))


@query(cte(CHOICES, CLAIMS) + _SCORED + """, g AS (SELECT o_custkey AS owner, t.* FROM t JOIN orders ON assignment = o_orderkey),
k AS (SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.owner = b.owner AND a.assignment <> b.assignment AND b.score >= a.score AND list_has_all(b.clusters, a.clusters) AND b.explicit >= a.explicit AND (b.score > a.score OR b.clusters <> a.clusters OR b.explicit > a.explicit)))
SELECT owner, assignment, CAST(row_number() OVER (PARTITION BY owner ORDER BY score DESC, len(clusters) DESC, explicit DESC, assignment) AS INTEGER) AS place FROM k""")
def undominated_assignments(spark, sf_dir):
    from .projections import table

    claims, choices = CLAIMS.frame(spark, sf_dir), CHOICES.frame(spark, sf_dir)
    scores = bd.assignment_scores(choices, claims.select("claim", "authority"), claims.select("claim", "cluster"))
    own = choices.join(claims, "claim", "left").groupBy("assignment").agg(F.collect_set("cluster").alias("clusters"), F.count_if(F.col("authority").isin("A", "B", "C")).alias("explicit"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assignment"), F.col("o_custkey").alias("owner"))
    return bd.undominated(scores.join(own, "assignment").join(owners, "assignment"), "owner").select("owner", "assignment", "place")


OUTCOMES = View("outcomes", "lineitem", unit="l_orderkey", status=cases("l_partkey", "PASS", "FAIL", "UNKNOWN", "PASS"))


@query(cte(UNITS, OUTCOMES) + ", s AS (SELECT unit, list_sort(list(DISTINCT status)) AS st FROM outcomes GROUP BY unit) SELECT unit, coalesce(array_to_string(st, ','), '') AS statuses FROM units FULL JOIN s USING (unit)")
def unit_statuses(spark, sf_dir):
    return bd.unit_statuses(UNITS.frame(spark, sf_dir), OUTCOMES.frame(spark, sf_dir)).withColumn("statuses", F.array_join("statuses", ","))


OPERATIONS = View("operations", "supplier", operation="concat('op', CAST(s_suppkey AS STRING))", source="s_suppkey * 3")
MAY_CALL = View("may_call", "supplier", operation="concat('op', CAST(s_suppkey AS STRING))", target="s_suppkey + s_nationkey")


@query(cte(UNIT_NODES, OPERATIONS, MAY_CALL) + """, a AS (SELECT operation, source AS node FROM operations UNION ALL SELECT operation, target FROM may_call), h AS (SELECT DISTINCT unit, operation FROM unit_nodes JOIN a USING (node))
SELECT unit, operation, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY operation) AS place FROM h) WHERE place <= 40""")
def protocol_projection(spark, sf_dir):
    return bd.protocol_projection(*[v.frame(spark, sf_dir) for v in (UNIT_NODES, OPERATIONS, MAY_CALL)])


REQS = View("reqs", "supplier", requirement="concat('r', CAST(s_suppkey AS STRING))", evidence="concat('e', CAST(s_nationkey AS STRING))", symbol="concat('pkg.m', CAST(s_suppkey AS STRING), '.F', CAST(s_nationkey AS STRING))")
CHECKS = View("checks", "part", check_id="p_partkey", role=cases("p_partkey", "TARGET", "PRESERVATION", "EXPLORATION"), named="concat('r', CAST(p_partkey % 23 AS STRING))", evidence="concat('e', CAST(p_size AS STRING))", oracle="concat('r', CAST(p_size % 31 AS STRING))", symbol="CASE p_partkey % 3 WHEN 0 THEN concat('m', CAST(p_partkey % 10 AS STRING), '.F', CAST(p_size % 25 AS STRING)) WHEN 1 THEN concat('F', CAST(p_size % 25 AS STRING)) ELSE '' END")


@query(cte(REQS, CHECKS) + """, o AS (SELECT requirement, check_id, role, named = requirement OR c.evidence = r.evidence OR oracle = requirement OR (c.symbol <> '' AND (c.symbol = r.symbol OR ends_with(r.symbol, '.' || c.symbol) OR ends_with(c.symbol, '.' || r.symbol) OR (contains(c.symbol, '.') AND split_part(c.symbol, '.', 2) = split_part(r.symbol, '.', 3)))) AS binds FROM reqs r, checks c)
SELECT requirement, check_id, CASE role WHEN 'EXPLORATION' THEN 'CHALLENGE' ELSE role END AS role FROM o WHERE binds""")
def check_projection(spark, sf_dir):
    one = lambda c: F.array(c)
    reqs = REQS.frame(spark, sf_dir).select("requirement", one("evidence").alias("evidence"), one("symbol").alias("symbols"))
    checks = CHECKS.frame(spark, sf_dir).select("check_id", "role", one("named").alias("requirements"), one("evidence").alias("evidence"), "oracle", one("symbol").alias("symbols"))
    return bd.check_projection(reqs, checks)


OLD_NODES = View("old_nodes", "part", node="p_partkey", kind="p_type", label="p_brand", has="p_size <> 7")
NEW_NODES = View("new_nodes", "part", node="p_partkey", kind="p_type", label="CASE WHEN p_size = 9 THEN 'other' ELSE p_brand END")


@query(cte(OLD_NODES, NEW_NODES) + " SELECT n.node FROM new_nodes n JOIN old_nodes o USING (node) WHERE has AND (n.kind, n.label) <> (o.kind, o.label)")
def graph_node_collisions(spark, sf_dir):
    return bd.add_nodes(OLD_NODES.frame(spark, sf_dir).where("has").drop("has"), NEW_NODES.frame(spark, sf_dir))[1]


@query(cte(OLD_NODES, NEW_NODES) + " SELECT node, kind, label FROM old_nodes WHERE has UNION ALL SELECT node, kind, label FROM new_nodes ANTI JOIN (SELECT node FROM old_nodes WHERE has) USING (node)")
def graph_add_nodes(spark, sf_dir):
    return bd.add_nodes(OLD_NODES.frame(spark, sf_dir).where("has").drop("has"), NEW_NODES.frame(spark, sf_dir))[0]


RELATED = View("related", "lineitem", edge_id="l_orderkey", kind=cases("l_linenumber", "calls", "custom:x", "unknown", "returns"))


@query(cte(RELATED) + " SELECT kind, count(*) AS n FROM related WHERE kind <> 'unknown' GROUP BY kind")
def registered_relations(spark, sf_dir):
    return bd.registered_relations(RELATED.frame(spark, sf_dir), ["calls", "returns"]).groupBy("kind").agg(F.count("*").alias("n"))


TARGETED = View("targeted", "lineitem", edge_id="l_orderkey", target="l_suppkey % 4")


@query(cte(TARGETED) + ", t AS (SELECT edge_id, list_sort(list(DISTINCT target)) AS targets FROM targeted GROUP BY edge_id) SELECT array_to_string(targets, ',') AS targets, count(*) AS n FROM t GROUP BY targets")
def interned_targets(spark, sf_dir):
    edges = TARGETED.frame(spark, sf_dir).groupBy("edge_id").agg(F.collect_list("target").alias("targets"))
    return bd.target_sets(edges).withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


REPORT_RUNS = View("report_runs", "customer", run="c_custkey")
REPORT_ROWS = View("report_rows", "orders", run="o_custkey", status=cases("o_orderkey", "PASS", "FAIL", "OPEN", "UNKNOWN"), hard="o_orderpriority = '1-URGENT'", decision=cases("o_orderkey", "COMMIT", "ROLLBACK", "KEEP_UNCERTIFIED"))


@query(cte(REPORT_RUNS, REPORT_ROWS) + """ SELECT r.run, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status NOT IN ('PASS', 'FAIL')) AS unknown, count(*) FILTER (hard AND status = 'OPEN') AS hard_open, count(*) FILTER (status = 'OPEN') AS open,
  count(*) FILTER (decision = 'COMMIT') AS commits, count(*) FILTER (decision = 'ROLLBACK') AS rollbacks FROM report_runs r LEFT JOIN report_rows x ON r.run = x.run GROUP BY r.run""")
def run_report(spark, sf_dir):
    rows = REPORT_ROWS.frame(spark, sf_dir)
    return bd.run_report(REPORT_RUNS.frame(spark, sf_dir), rows, rows, rows)


KEYED = View("keyed", "lineitem", obligation="l_partkey", leaf="l_suppkey", a="l_linenumber % 2", b="l_linenumber % 3", entry="l_returnflag", exit="l_linestatus")


@query(cte(KEYED) + " SELECT leaf, least(a, b) || ',' || greatest(a, b) AS constraints, entry, 'g' AS guards, exit, min(obligation) AS first, count(*) AS n FROM keyed GROUP BY ALL")
def obligation_keys(spark, sf_dir):
    rows = KEYED.frame(spark, sf_dir).select("obligation", "leaf", F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("constraints"), "entry", F.lit("g").alias("guards"), "exit", F.lit("o").alias("observation"))
    return bd.obligation_keys(rows).withColumn("constraints", F.array_join("constraints", ",")).drop("observation")
