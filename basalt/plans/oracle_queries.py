"""Queries over oracles: an order is a scenario with a base run and a patched one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import oracles
from .views import Registry, View, cases, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

RUNS = View(
    "runs", "orders", id="o_orderkey", active="o_orderkey % 12 <> 0", kind=cases("o_orderkey", "equality", "exception", "preservation", "input_identity", "idempotence", "temporal", "equality"),
    expected="CAST(o_orderkey % 3 AS STRING)", base_return="CAST(o_custkey % 3 AS STRING)", patch_return="CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 4 AS STRING) END",
    etype=cases("o_custkey", "ValueError", "KeyError"), thrown=cases("o_orderkey", "ValueError", "KeyError", "ValueError"), said=cases("o_orderkey", "Bad Input here", "not found", "BAD input"), category="CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'bad input' END",
    phase="CASE WHEN o_custkey % 5 = 0 THEN 'stimulus' ELSE NULL END", stage=cases("o_orderkey", "stimulus", "setup"), has_baseline="o_orderkey % 9 <> 0", has_input="o_orderkey % 8 <> 0", identity="CAST(o_custkey % 2 AS STRING)", returned="CAST(o_orderkey % 2 AS STRING)",
    n_related="o_orderkey % 3", same_environment="o_orderkey % 15 <> 0", setup_failure="o_orderkey % 16 = 0", reached="o_orderkey % 17 <> 0", base_broken="o_custkey % 18 = 0", patch_broken="o_orderkey % 18 = 0", scenario=cases("o_custkey", "TARGET", "PRESERVATION", "TARGET", "PRESERVATION", "OTHER"), has_state="o_orderkey % 10 <> 0", needs_state="o_custkey % 2 = 0",
)
_THROWN = "(thrown = etype AND (category IS NULL OR contains(lower(said), category)) AND (phase IS NULL OR phase = stage))"
_SAME = "patch_return IS NOT DISTINCT FROM base_return"


def _oracle(r):
    none = F.lit(None).cast("string")
    return oracles.Oracle(r("active"), r("kind"), F.array(F.lit("return")), none, r("expected"), r("etype"), r("category"), r("phase"), F.lit("x"))


def _channels(side: str):
    r = F.col
    thrown = F.to_json(F.struct(r("thrown").alias("type"), r("said").alias("message"), r("stage").alias("stage")))
    have = F.create_map(F.lit("return"), r(f"{side}_return"), F.lit("exception"), thrown, F.lit("input_identity:x"), r("identity"), F.lit("return_identity"), r("returned"))
    return F.when(r("has_state"), F.map_concat(have, F.create_map(F.lit("state"), F.lit("1")))).otherwise(have) if side == "patch" else F.map_concat(have, F.create_map(F.lit("state"), F.lit("1")))


@query(cte(RUNS) + f""" SELECT id,
  CASE WHEN NOT active THEN 'UNKNOWN' WHEN kind = 'equality' THEN CASE WHEN patch_return = expected THEN 'PASS' ELSE 'FAIL' END WHEN kind = 'exception' THEN CASE WHEN {_THROWN} THEN 'PASS' ELSE 'FAIL' END
    WHEN kind = 'preservation' THEN CASE WHEN NOT has_baseline THEN 'UNKNOWN' WHEN {_SAME} THEN 'PASS' ELSE 'FAIL' END
    WHEN kind = 'input_identity' THEN CASE WHEN NOT has_input THEN 'UNKNOWN' WHEN identity = returned THEN 'PASS' ELSE 'FAIL' END
    WHEN kind = 'idempotence' THEN CASE WHEN n_related = 0 THEN 'UNKNOWN' WHEN {_SAME} THEN 'PASS' ELSE 'FAIL' END ELSE 'UNKNOWN' END AS status,
  CASE WHEN NOT active THEN 'oracle_not_active' WHEN kind = 'equality' THEN 'equality' WHEN kind = 'exception' THEN 'exception_type_message_phase'
    WHEN kind = 'preservation' THEN CASE WHEN has_baseline THEN 'baseline_differential' ELSE 'missing_baseline' END
    WHEN kind = 'input_identity' THEN CASE WHEN has_input THEN 'input_identity' ELSE 'missing_input_identity' END
    WHEN kind = 'idempotence' THEN CASE WHEN n_related = 0 THEN 'missing_related_trace' ELSE 'idempotence' END ELSE 'unsupported_oracle_relation' END AS reason FROM runs""")
def evaluate_oracle(spark, sf_dir):
    r = F.col
    base, patch = _channels("base"), _channels("patch")
    related = F.array_repeat(F.create_map(F.lit("return"), r("base_return")), r("n_related").cast("int"))
    verdict = oracles.evaluate_oracle(_oracle(r), patch, F.when(r("has_baseline"), base), F.when(r("has_input"), F.create_map(F.lit("x"), F.lit("1"))), related)
    return RUNS.frame(spark, sf_dir).select("id", verdict.alias("v")).select("id", "v.*")


@query(cte(RUNS) + f""", v AS (SELECT *, NOT needs_state OR has_state AS patch_full,
  CASE WHEN base_return = expected THEN 'PASS' ELSE 'FAIL' END AS base_eq, CASE WHEN patch_return = expected THEN 'PASS' ELSE 'FAIL' END AS patch_eq, CASE WHEN {_SAME} THEN 'PASS' ELSE 'FAIL' END AS kept FROM runs),
l AS (SELECT id, CASE WHEN NOT same_environment THEN 'environment_mismatch' WHEN setup_failure THEN 'shared_nonbehavioral_failure' WHEN NOT reached THEN 'invalid_base_scenario' WHEN patch_broken AND NOT base_broken THEN 'patch_specific_mechanical'
  WHEN scenario = 'TARGET' THEN CASE WHEN NOT active THEN 'oracle_not_active' WHEN NOT patch_full THEN 'patch_observation_channel_missing' WHEN base_eq <> 'FAIL' THEN 'base_precondition_false' ELSE 'target_predicate' END
  WHEN scenario <> 'PRESERVATION' THEN 'unsupported_scenario_kind' WHEN NOT patch_full THEN 'observation_not_comparable' WHEN NOT active THEN 'preservation_not_established' ELSE 'preservation_predicate' END AS reason, patch_eq, kept FROM v)
SELECT id, reason, CASE reason WHEN 'patch_specific_mechanical' THEN 'FAIL' WHEN 'target_predicate' THEN patch_eq WHEN 'preservation_predicate' THEN kept ELSE 'UNKNOWN' END AS status,
  CASE reason WHEN 'environment_mismatch' THEN 'ENVIRONMENT' WHEN 'shared_nonbehavioral_failure' THEN 'SHARED_SETUP_OR_DEPENDENCY' WHEN 'invalid_base_scenario' THEN 'SCENARIO' WHEN 'unsupported_scenario_kind' THEN 'SCENARIO' WHEN 'patch_specific_mechanical' THEN 'PATCH_MECHANICAL'
    WHEN 'oracle_not_active' THEN 'ORACLE' WHEN 'patch_observation_channel_missing' THEN 'OBSERVATION_SCHEMA' WHEN 'observation_not_comparable' THEN 'OBSERVATION_SCHEMA' WHEN 'base_precondition_false' THEN 'SCENARIO_PRECONDITION' WHEN 'preservation_not_established' THEN 'BASELINE'
    WHEN 'target_predicate' THEN CASE patch_eq WHEN 'FAIL' THEN 'TARGET_BEHAVIOR' ELSE 'NONE' END ELSE CASE kept WHEN 'FAIL' THEN 'PRESERVATION' ELSE 'NONE' END END AS origin,
  reason IN ('patch_specific_mechanical', 'base_precondition_false', 'target_predicate', 'preservation_not_established', 'preservation_predicate') AS comparable FROM l""")
def classify_pair(spark, sf_dir):
    """Targets are held against an equality, preservation against the base run's own channels."""
    r = F.col
    base, patch = _channels("base"), _channels("patch")
    none = F.lit(None).cast("map<string,string>")
    keeps = r("scenario") == "PRESERVATION"
    kind = F.when(keeps, "preservation").otherwise("equality")
    oracle = oracles.Oracle(r("active"), kind, F.array(F.lit("return")), F.lit(None).cast("string"), r("expected"), r("etype"), r("category"), r("phase"), F.lit("x"))
    against = F.when(keeps, base)
    no_related = F.array().cast("array<map<string,string>>")
    verdicts = [oracles.evaluate_oracle(oracle, run, against, none, no_related) for run in (base, patch)]
    run = lambda channels, env, broken: F.struct(env.alias("environment"), r("setup_failure"), F.lit(False).alias("dependency_failure"), F.lit(None).cast("boolean").alias("global_timeout"), r("reached").alias("observation_reached"), r(broken).alias("mechanical_failure"), channels.alias("channels"))
    required = F.when(r("needs_state"), F.array(F.lit("return"), F.lit("state"))).otherwise(F.array(F.lit("return")))
    out = oracles.classify_pair(run(base, F.lit("e0"), "base_broken"), run(patch, F.when(r("same_environment"), "e0").otherwise("e1"), "patch_broken"), r("scenario"), required, r("active"), *verdicts)
    return RUNS.frame(spark, sf_dir).select("id", out.alias("v")).select("id", "v.*")


DECISIONS = View("decisions", "customer", id="c_custkey", decision=cases("c_custkey", "restore", "narrow", "downgrade", "revoke", "narrow", "other"), relation="c_mktsegment", narrowed="CASE WHEN c_custkey % 12 < 6 THEN 'x == 1' ELSE '' END", old=cases("c_custkey", "b", "a", "c"), more=cases("c_nationkey", "a", "d"))


@query(cte(DECISIONS) + """ SELECT id, CASE decision WHEN 'restore' THEN 'ACTIVE' WHEN 'narrow' THEN CASE WHEN narrowed <> '' THEN 'ACTIVE' END WHEN 'downgrade' THEN 'DOWNGRADED' WHEN 'revoke' THEN 'REVOKED' END AS lifecycle,
  CASE WHEN decision = 'restore' OR (decision = 'narrow' AND narrowed <> '') THEN true WHEN decision IN ('downgrade', 'revoke') THEN false END AS executable,
  CASE WHEN decision = 'narrow' THEN nullif(narrowed, '') WHEN decision <> 'other' THEN relation END AS relation,
  CASE WHEN old = more THEN old ELSE least(old, more) || ',' || greatest(old, more) END AS contested FROM decisions""")
def adjudicate_oracle(spark, sf_dir):
    r = F.col
    out = oracles.adjudicate(r("decision"), r("relation"), r("narrowed"))
    contested = oracles.contest(F.array(r("old")), F.array(r("more")))
    return DECISIONS.frame(spark, sf_dir).select("id", out["lifecycle"].alias("lifecycle"), out["executable"].alias("executable"), out["relation"].alias("relation"), F.array_join(contested["evidence"], ",").alias("contested"))
