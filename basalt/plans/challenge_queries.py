"""Queries over challenges of a diff: an order is a diff, its lineitems its relations, checks and challenges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import challenges
from .views import Registry, View, cases, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_CHANGES = ("guard_added", "call_modified", "fallback_deleted", "return_modified", "state_deleted", "dispatch_added", "resource_modified", "external_surface_modified", "external_effect_added", "assignment_deleted", "comment_added", "external_effect_deleted", "guard_deleted")
RELATIONS = View("relations", "part", relation="p_partkey", change=cases("p_partkey", *_CHANGES), predicate="CASE WHEN p_size > 25 THEN concat('size > ', CAST(p_size AS STRING)) ELSE '' END")


@query(cte(RELATIONS) + """, p AS (SELECT relation, change, CASE WHEN predicate = '' THEN 'True' ELSE predicate END AS predicate FROM relations),
h(part, handler, kind) AS (VALUES ('guard', 'changed_guard', 'guard'), ('call', 'call_exits', 'call_exit'), ('fallback', 'fallback_return', 'fallback'), ('return', 'fallback_return', 'fallback'), ('state', 'state_lifecycle', 'state'), ('dispatch', 'protocol_dispatch', 'dispatch'), ('resource', 'resource_lifetime', 'resource'), ('external', 'external_effect', 'external_effect'), ('assignment', 'alias_flow', 'alias_flow')),
x(handler, partition, expected_exit) AS (VALUES ('changed_guard', 'true', 'true'), ('changed_guard', 'false', 'false'), ('changed_guard', 'boundary', 'boundary'), ('call_exits', 'normal', 'normal'), ('call_exits', 'exception', 'exception'),
  ('fallback_return', 'predecessor', 'former_fallback'), ('state_lifecycle', 'predecessor', 'predecessor'), ('state_lifecycle', 'successor', 'successor'), ('state_lifecycle', 'repeated', 'repeated'), ('state_lifecycle', 'recovery', 'recovery'),
  ('protocol_dispatch', 'left_right', 'left_right'), ('protocol_dispatch', 'right_left', 'right_left'), ('protocol_dispatch', 'not_implemented_fallback', 'not_implemented_fallback'), ('protocol_dispatch', 'truthy', 'truthy'), ('protocol_dispatch', 'falsy', 'falsy'), ('protocol_dispatch', 'empty', 'empty'), ('protocol_dispatch', 'nonempty', 'nonempty'),
  ('resource_lifetime', 'normal_release', 'normal_release'), ('resource_lifetime', 'exception_release', 'exception_release'), ('external_effect', 'before', 'before'), ('external_effect', 'after', 'after'), ('alias_flow', 'direct', 'consumer'), ('alias_flow', 'aliased', 'consumer'))
SELECT relation, handler, kind, partition, CASE WHEN kind = 'guard' AND partition = 'true' THEN predicate WHEN kind = 'guard' AND partition = 'false' THEN 'not (' || predicate || ')' ELSE '' END AS constraints, expected_exit
FROM p JOIN h ON split_part(change, '_', 1) = part JOIN x USING (handler) WHERE change <> 'external_effect_deleted'""")
def guard_exit_expansion(spark, sf_dir):
    return challenges.relation_exits(RELATIONS.frame(spark, sf_dir)).withColumn("constraints", F.array_join("constraints", " and "))


DIFFS = View("diffs", "orders", diff="o_orderkey", path_obligations="o_orderkey % 9", active_bindings="CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 2 END", real_challenges="o_orderkey % 3")
TARGETS = View("targets", "lineitem", diff="l_orderkey", check_id="concat('c', CAST(l_linenumber AS STRING))", is_target="l_linenumber % 3 = 1 AND l_partkey % 7 <> 0")
PAIRS = View("pairs", "lineitem", diff="l_orderkey", comparison="l_partkey", check_id="concat('c', CAST(l_linenumber AS STRING))", **{"class": "CASE WHEN l_partkey % 60 = 0 THEN 'FLAKY_RESULT' WHEN l_partkey % 31 = 0 THEN 'TARGET_STILL_FAILING' WHEN l_partkey % 29 = 0 THEN 'PRESERVATION_REGRESSION' WHEN l_partkey % 13 = 0 THEN 'PASS_PRESERVED' ELSE 'TARGET_FIXED' END"})
UNCOVERED = View("uncovered", "lineitem", diff="l_orderkey", partition="l_suppkey", is_open="l_suppkey % 10 = 3")
EXECUTED = View("executed", "lineitem", diff="l_orderkey", challenge="concat('ch', CAST(l_suppkey AS STRING))", ran="l_returnflag = 'A'")
_ONE = """t AS (SELECT DISTINCT diff, check_id FROM targets WHERE is_target), p AS (SELECT diff, check_id, min(comparison) AS comparison, arg_min(class, (comparison, class)) AS class FROM pairs GROUP BY diff, check_id),
pt AS (SELECT p.*, t.check_id IS NOT NULL AS target FROM p LEFT JOIN t USING (diff, check_id))"""


@query(cte(DIFFS, TARGETS, PAIRS, UNCOVERED, EXECUTED) + f""", {_ONE},
nt AS (SELECT diff, count(*) AS n FROM t GROUP BY diff),
a AS (SELECT diff, count(*) FILTER (target) AS n, count(*) FILTER (target AND class <> 'TARGET_FIXED') AS unfixed, array_to_string(list_sort(list(check_id) FILTER (target AND class = 'TARGET_STILL_FAILING')), ',') AS failing, array_to_string(list_sort(list(check_id) FILTER (class = 'PRESERVATION_REGRESSION')), ',') AS worse, array_to_string(list_sort(list(check_id) FILTER (class = 'FLAKY_RESULT')), ',') AS flaky FROM pt GROUP BY diff),
u AS (SELECT diff, array_to_string(list_sort(list(DISTINCT partition)), ',') AS parts FROM uncovered WHERE is_open GROUP BY diff),
e AS (SELECT diff, array_to_string(list_sort(list(DISTINCT c)), ',') AS ran FROM (SELECT diff, 'target-comparison:' || comparison AS c FROM pt WHERE target UNION ALL SELECT diff, challenge FROM executed WHERE ran) GROUP BY diff),
j AS (SELECT d.diff, path_obligations, active_bindings, coalesce(nt.n, 0) AS targets, coalesce(a.n, 0) AS pairs, coalesce(unfixed, 0) AS unfixed, coalesce(failing, '') AS failing, coalesce(worse, '') AS worse, coalesce(flaky, '') AS flaky, coalesce(parts, '') AS parts, coalesce(ran, '') AS ran, real_challenges FROM diffs d LEFT JOIN nt USING (diff) LEFT JOIN a USING (diff) LEFT JOIN u USING (diff) LEFT JOIN e USING (diff)),
r AS (SELECT *, CASE WHEN targets = 0 THEN 'no executable target' WHEN path_obligations <= 0 THEN 'no executable requirement path obligation' WHEN active_bindings <= 0 THEN 'no active executable binding' WHEN pairs = 0 THEN 'no real target execution'
  WHEN flaky <> '' THEN 'required check environment is unavailable or unstable' WHEN failing <> '' THEN 'stable target failure remains' WHEN worse <> '' THEN 'preservation regression remains' WHEN parts <> '' THEN 'touched branch partition is uncovered' WHEN unfixed > 0 THEN 'not every target is fixed' ELSE 'all executable targets and required impact checks passed' END AS reason FROM j)
SELECT diff, CASE WHEN reason LIKE 'no %' THEN 'NOT_EVALUABLE' WHEN reason LIKE 'required%' THEN 'BLOCKED_EXTERNAL' WHEN reason LIKE 'all %' THEN 'CLOSED' ELSE 'OPEN' END AS status, reason, CAST(targets AS BIGINT) AS targets, CAST(pairs AS BIGINT) AS target_executions, CAST(pairs + real_challenges AS BIGINT) AS challenge_executions,
  failing AS stable_failures, worse AS regressions, flaky AS environment, parts AS uncovered, ran AS executed FROM r""")
def diff_certificate(spark, sf_dir):
    """Each check has the comparison with the least part."""
    f = lambda v: v.frame(spark, sf_dir)
    pairs = f(PAIRS).groupBy("diff", "check_id").agg(F.min("comparison").alias("comparison"), F.min_by("class", F.struct("comparison", "class")).alias("class"))
    out = challenges.evaluate_dicc(f(DIFFS), f(TARGETS).where("is_target").select("diff", "check_id").distinct(), pairs, f(UNCOVERED).where("is_open").select("diff", "partition").distinct(), f(EXECUTED).where("ran").select("diff", "challenge"))
    lists = ["stable_failures", "regressions", "environment", "uncovered", "executed"]
    return out.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in lists else c for c in out.columns])


CELLS = View("cells", "orders", id="o_orderkey", cell="CASE o_orderstatus WHEN 'P' THEN 'PASS' ELSE 'FAIL' END", authority=cases("o_orderkey", "A", "B", "D"), executable="o_orderkey % 5 <> 0", stability=cases("o_custkey", "STABLE", "STABLE", "FLAKY"), base_runs="2 + o_orderkey % 2", patch_runs="1 + o_custkey % 3", base_outcome=cases("o_custkey", "PASS", "FAIL", "PASS", "PASS"), patch_outcome="'FAIL'", bound="o_orderkey % 7 <> 0")


@query(cte(CELLS) + " SELECT id FROM cells WHERE cell = 'FAIL' AND authority IN ('A', 'B') AND executable AND stability = 'STABLE' AND patch_runs >= 2 AND base_outcome = 'PASS' AND bound")
def confirmed_challenges(spark, sf_dir):
    c = F.col
    rule = challenges.is_confirmed(c("cell"), c("authority"), c("executable"), c("stability"), c("base_runs"), c("patch_runs"), c("base_outcome"), c("patch_outcome"), c("bound"))
    return CELLS.frame(spark, sf_dir).where(rule).select("id")


PROPOSALS = View("proposals", "orders", id="o_orderkey", unit_oracle="o_custkey", locked="CASE WHEN o_orderkey % 6 = 0 THEN o_custkey + 1 ELSE o_custkey END", scenario="CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_custkey END", active="o_orderkey % 7 <> 0", unresolved="CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END", fault="CASE WHEN o_orderkey % 9 = 0 THEN 'too long' ELSE NULL END", channel="CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'return' END")


@query(cte(PROPOSALS) + """, r AS (SELECT id, CASE WHEN unit_oracle <> locked THEN 'oracle_not_locked_to_binding' WHEN scenario <> locked THEN 'scenario_changed_locked_oracle' WHEN NOT active THEN 'oracle_not_active_ABC' WHEN unresolved > 0 THEN 'proposal_has_unresolved_fields'
  WHEN fault IS NOT NULL THEN 'recipe_rejected:' || fault WHEN channel = '' THEN 'observation_channel_missing' ELSE 'admitted' END AS reason FROM proposals) SELECT id, reason = 'admitted' AS admitted, reason FROM r""")
def admitted_scenarios(spark, sf_dir):
    c = F.col
    out = challenges.admit(c("unit_oracle"), c("locked"), c("scenario"), c("active"), c("unresolved"), c("fault"), c("channel"))
    return PROPOSALS.frame(spark, sf_dir).select("id", out.alias("v")).select("id", "v.*")


NAMES = View("names", "part", id="p_partkey", executed=cases("p_partkey", "pkg.table.QTable", "QTable", "pkg.table.table.QTable", "", "load", "pkg.io.load"), bound=cases("p_size", "pkg.table.QTable", "table.QTable", "other.QTable", "load", "pkg.io.load", "", "io.load"), requirement="concat('r', CAST(p_size % 4 AS STRING))", wanted="concat('r', CAST(p_partkey % 4 AS STRING))", evidence="concat('e', CAST(p_size % 5 AS STRING))", source="concat('e', CAST(p_partkey % 7 AS STRING))", oracle="concat('r', CAST(p_partkey % 11 AS STRING))")


@query(cte(NAMES) + """, o AS (SELECT *, executed <> '' AND bound <> '' AND (executed = bound OR ends_with(executed, '.' || bound) OR ends_with(bound, '.' || executed) OR (contains(executed, '.') AND contains(bound, '.') AND regexp_extract(executed, '[^.]*$') = regexp_extract(bound, '[^.]*$'))) AS overlap FROM names)
SELECT id, overlap, overlap OR requirement = wanted OR evidence = source OR oracle = requirement AS binds FROM o""")
def check_binds_requirement(spark, sf_dir):
    c, one = F.col, lambda n: F.array(F.col(n))
    binds = challenges.check_binds_requirement(c("requirement"), one("evidence"), one("wanted"), one("source"), c("oracle"), one("executed"), one("bound"))
    return NAMES.frame(spark, sf_dir).select("id", challenges.symbols_overlap(c("executed"), c("bound")).alias("overlap"), binds.alias("binds"))


NODES = View("nodes", "events", node="event_id", file="user_id", line="event_id", end_line="CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id + event_id % 300 END")
HUNKS = View("hunks", "events", file="user_id", new_start="event_id + 3", new_count="event_id % 4", changed="event_type = 'click'")


@query(cte(NODES, HUNKS) + " SELECT DISTINCT node FROM nodes n JOIN hunks h ON n.file = h.file WHERE changed AND line <= new_start + greatest(new_count, 1) - 1 AND coalesce(end_line, line) >= new_start")
def changed_program_nodes(spark, sf_dir):
    return challenges.changed_nodes(NODES.frame(spark, sf_dir), HUNKS.frame(spark, sf_dir).where("changed"))
