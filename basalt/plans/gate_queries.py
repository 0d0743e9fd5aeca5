"""Queries over gates: an order is a state, its lineitems are outcomes, checks and counterexamples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from .views import Registry, View, cases, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

STATES = View(
    "states", "orders", state="o_orderkey", forbidden_edit="o_orderkey % 17 = 0", oracle_contamination="o_custkey % 25 = 3", has_diff="o_orderkey % 9 <> 0", has_recovery="o_orderkey % 7 <> 0",
    safe="o_orderkey % 5 <> 0", confirmed_failures="CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END", fallback_used="o_orderkey % 19 = 0", patch_status=cases("o_orderkey", "KEPT", "KEPT", "ROLLED_BACK", "KEPT", "EMPTY", "KEPT"),
    diff_closed="o_orderkey % 11 <> 0", hashes_current="o_orderkey % 23 <> 0", public_failures="CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE 0 END", pending="CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END",
    budget_left="o_custkey % 3 = 0", termination=cases("o_orderkey", "RUNNING", "ORACLE_BLOCKED", "REACHED", "MECHANICAL_FAILURE"), reached="o_orderkey % 4 = 0",
)
MECHANICAL = View("mechanical", "orders", state="o_orderkey", status="CASE WHEN o_totalprice < 50000 THEN 'FAIL' ELSE 'PASS' END")
_STATUS = "CASE WHEN l_partkey % 11 = 0 THEN 'FAIL' WHEN l_partkey % 23 = 0 THEN 'UNKNOWN' ELSE 'PASS' END"
OUTCOMES = View("outcomes", "lineitem", is_old="l_suppkey % 2 = 0", state="l_orderkey", seq="l_partkey", unit="l_linenumber % 4", kind="CASE WHEN l_linenumber = 2 THEN 'PRESERVATION' ELSE 'TARGET' END", status=_STATUS, stable="l_suppkey % 3 <> 0", challenge="CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_partkey % 5 END")
TARGETS = View("targets", "lineitem", state="l_orderkey", check_id="l_partkey", tier=cases("l_partkey", "A", "B", "C", "D", "E", "A"), has_candidate="l_partkey % 8 <> 0", certified="l_linenumber <= 3")
COMPARISONS = View("comparisons", "lineitem", state="l_orderkey", check_id="l_partkey", **{"class": "CASE WHEN l_partkey % 37 = 0 THEN 'PRESERVATION_REGRESSION' WHEN l_partkey % 10 = 7 THEN 'FLAKY_RESULT' WHEN l_partkey % 29 = 0 THEN 'TARGET_STILL_FAILING' ELSE 'TARGET_FIXED' END"}, signature="CASE WHEN l_suppkey % 4 = 0 THEN l_returnflag ELSE '' END")
COUNTEREXAMPLES = View("counterexamples", "lineitem", state="l_orderkey", environment_valid="l_partkey % 2 = 0", signature="CASE WHEN l_partkey % 14 = 0 THEN l_returnflag ELSE '' END")
COVERAGE = View("coverage", "lineitem", state="l_orderkey", status="CASE WHEN l_partkey % 41 = 0 THEN 'FAILING' ELSE 'PASSING' END", bound="l_partkey % 2 = 1")
FRONTIERS = View("frontiers", "lineitem", state="l_orderkey", frontier="l_partkey % 50", graph="l_linenumber % 3", hard="l_returnflag = 'R'", status="CASE l_linestatus WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END")


def _frames(spark, sf_dir, *views):
    return [v.frame(spark, sf_dir) for v in views]


@query(cte(FRONTIERS) + " SELECT DISTINCT state, frontier FROM frontiers WHERE hard AND status = 'OPEN'")
def hard_frontiers(spark, sf_dir):
    f = FRONTIERS.frame(spark, sf_dir)
    return gates.hard_frontiers(*[f.where(F.col("graph") == g) for g in range(3)])


@query(cte(STATES, MECHANICAL, OUTCOMES) + """,
kept AS (SELECT DISTINCT state, challenge FROM outcomes WHERE is_old AND status = 'PASS' AND challenge IS NOT NULL),
late AS (SELECT state, challenge, arg_max(status, seq) AS now FROM outcomes WHERE NOT is_old AND challenge IS NOT NULL GROUP BY ALL),
lost AS (SELECT DISTINCT kept.state FROM kept LEFT JOIN late USING (state, challenge) WHERE coalesce(now, '') <> 'PASS')
SELECT state, array_to_string(list_sort(list_filter([
  CASE WHEN state IN (SELECT state FROM mechanical WHERE status <> 'PASS') THEN 'MECHANICAL_FAILURE' END,
  CASE WHEN forbidden_edit THEN 'FORBIDDEN_EDIT' END, CASE WHEN oracle_contamination THEN 'ORACLE_CONTAMINATION' END,
  CASE WHEN state IN (SELECT state FROM lost) THEN 'ESTABLISHED_SUCCESS_LOST' END,
  CASE WHEN state IN (SELECT state FROM outcomes WHERE NOT is_old AND kind = 'PRESERVATION' AND status = 'FAIL' AND stable) THEN 'PRESERVATION_FAILURE' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM states""")
def raw_avoid_reasons(spark, sf_dir):
    states, mechanical, o = _frames(spark, sf_dir, STATES, MECHANICAL, OUTCOMES)
    return gates.raw_avoid_reasons(states, o.where("is_old"), o.where("not is_old"), mechanical).select("state", F.array_join("reasons", ",").alias("reasons"))


_TRUSTED = "trusted AS (SELECT DISTINCT state, check_id FROM targets WHERE tier IN ('A', 'B', 'C') AND has_candidate AND certified)"


@query(cte(STATES, TARGETS, COMPARISONS, COUNTEREXAMPLES, COVERAGE) + f""", {_TRUSTED},
pairs AS (SELECT state, count(*) AS n, bool_and(class = 'TARGET_FIXED') AS fixed FROM comparisons SEMI JOIN trusted USING (state, check_id) GROUP BY state),
wanted AS (SELECT state, count(*) AS n FROM trusted GROUP BY state)
SELECT state, coalesce(has_diff AND pairs.n = wanted.n AND fixed AND safe AND confirmed_failures = 0 AND NOT fallback_used
  AND state NOT IN (SELECT state FROM comparisons WHERE class = 'PRESERVATION_REGRESSION')
  AND state NOT IN (SELECT x.state FROM counterexamples x JOIN comparisons c ON x.state = c.state AND x.signature = c.signature WHERE environment_valid AND x.signature <> '')
  AND state NOT IN (SELECT state FROM coverage WHERE bound AND status <> 'PASSING'), false) AS reached
FROM states LEFT JOIN pairs USING (state) LEFT JOIN wanted USING (state)""")
def in_target_set(spark, sf_dir):
    return gates.in_target_set(*_frames(spark, sf_dir, STATES, TARGETS, COMPARISONS, COUNTEREXAMPLES, COVERAGE))


@query(cte(STATES, OUTCOMES, TARGETS) + """,
units AS (SELECT DISTINCT state, unit, unit <> 2 AS is_target, unit >= 2 AS is_preservation FROM outcomes),
public AS (SELECT DISTINCT state, check_id % 4 AS unit FROM targets WHERE tier = 'E'),
ok AS (SELECT state, unit, bool_and(status = 'PASS') AS ok FROM outcomes GROUP BY ALL),
s AS (SELECT u.state, bool_or(is_target) AS any_target, bool_and(NOT is_target OR coalesce(ok, false) OR p.unit IS NOT NULL) AS pass, bool_and(NOT is_preservation OR coalesce(ok, false)) AS kept
  FROM units u LEFT JOIN ok USING (state, unit) LEFT JOIN public p USING (state, unit) GROUP BY u.state)
SELECT state, coalesce(has_diff AND safe AND any_target AND pass AND kept AND public_failures = 0 AND diff_closed AND hashes_current AND pending = 0
  AND state NOT IN (SELECT state FROM outcomes WHERE status = 'FAIL' AND stable), false) AS reached FROM states LEFT JOIN s USING (state)""")
def in_target_set_by_units(spark, sf_dir):
    states, outcomes, targets = _frames(spark, sf_dir, STATES, OUTCOMES, TARGETS)
    unit = F.col("unit")
    units = outcomes.select("state", "unit", (unit != 2).alias("is_target"), (unit >= 2).alias("is_preservation")).distinct()
    return gates.in_target_set_by_units(states, units, outcomes, targets.where("tier = 'E'").select("state", (F.col("check_id") % 4).alias("unit")))


@query(cte(STATES, TARGETS, COMPARISONS) + f""", {_TRUSTED}
SELECT state, has_diff AND has_recovery AND safe AND confirmed_failures = 0 AND patch_status NOT IN ('ROLLED_BACK', 'EMPTY')
  AND state NOT IN (SELECT state FROM trusted) AND state NOT IN (SELECT state FROM comparisons WHERE class = 'PRESERVATION_REGRESSION') AS complete FROM states""")
def evidence_limited_complete(spark, sf_dir):
    return gates.evidence_limited_complete(*_frames(spark, sf_dir, STATES, TARGETS, COMPARISONS))


@query(cte(STATES) + """ SELECT state, CASE
  WHEN NOT budget_left AND NOT reached THEN CASE WHEN NOT has_diff THEN 'REVISION_BUDGET_EXHAUSTED_WITH_TARGET_FAILURE' WHEN safe AND confirmed_failures = 0 THEN NULL ELSE 'REVISION_BUDGET_EXHAUSTED_WITH_UNCERTIFIED_PATCH' END
  WHEN termination IN ('ORACLE_BLOCKED', 'MECHANICAL_FAILURE') THEN termination END AS reason FROM states""")
def terminal_avoid_reason(spark, sf_dir):
    s = STATES.frame(spark, sf_dir)
    return s.select("state", gates.terminal_avoid_reason(*[F.col(c) for c in ("budget_left", "reached", "has_diff", "safe", "confirmed_failures", "termination")]).alias("reason"))


TRIALS = View("trials", "orders", trial="o_orderkey", runs="o_orderkey % 4", regressions="CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END", safe="o_orderkey % 5 <> 0", blocked="o_orderkey % 7 = 0", fixed="o_orderkey % 3", deficit="CAST(o_totalprice % 2 AS DOUBLE)", gone="CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 0 END", risk="0")


@query(cte(TRIALS) + """, c AS (SELECT *, runs > 0 AND regressions = 0 AND safe AND (fixed > 0 OR deficit > 0 OR coalesce(gone, 0) > 0 OR risk > 0) AS commits FROM trials)
SELECT trial, commits, CASE WHEN regressions > 0 OR NOT (safe OR blocked) THEN 'ROLLBACK' WHEN blocked THEN 'KEEP_UNCERTIFIED' WHEN commits THEN 'COMMIT' ELSE 'ROLLBACK' END AS decision FROM c""")
def execution_transition(spark, sf_dir):
    t = TRIALS.frame(spark, sf_dir)
    commits = gates.should_commit(F.col("runs"), F.col("regressions"), F.col("safe"), *[F.col(c) for c in ("fixed", "deficit", "gone", "risk")])
    return t.select("trial", commits.alias("commits"), gates.decide_execution_transition(F.col("regressions"), F.col("safe"), F.col("blocked"), commits).alias("decision"))
