"""Oracle rules: what an observation says of a relation, and what a pair of runs says of a scenario.

Values are canonical JSON texts, so equal values are equal texts; a channel that is missing or null has the value null.
An observation is a map from channel to value. Results are structs of labels; a null condition counts as false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A relation's kinds.
KINDS = ["equality", "exception", "preservation", "input_identity", "idempotence"]


@dataclass(frozen=True)
class Oracle:
    """Columns of an oracle's row. `channels`: array; the others: text, null where the relation doesn't name them."""

    active: Column
    kind: Column
    channels: Column
    channel: Column
    expected: Column
    expected_type: Column
    message_category: Column
    phase: Column
    input_name: Column


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def evaluate_oracle(oracle: Oracle, observation: Column, baseline: Column, inputs: Column, related: Column) -> Column:
    """struct(status, reason). baseline, inputs: maps or null; related: array of observations or null."""
    verdict = lambda ok, reason: F.struct(F.when(yes(ok), "PASS").otherwise("FAIL").alias("status"), F.lit(reason).alias("reason"))
    unknown = lambda reason: F.struct(F.lit("UNKNOWN").alias("status"), F.lit(reason).alias("reason"))
    thrown = lambda field: F.get_json_object(observation["exception"], f"$.{field}")
    said = F.lower(F.coalesce(thrown("message"), F.lit("")))
    message = oracle.message_category.isNull() | F.contains(said, F.lower(oracle.message_category))
    raised = thrown("type").eqNullSafe(oracle.expected_type) & message & (oracle.phase.isNull() | oracle.phase.eqNullSafe(thrown("stage")))
    kept = F.forall(oracle.channels, lambda c: baseline[c].eqNullSafe(observation[c]))
    name = F.coalesce(oracle.input_name, F.lit("x"))
    same = observation[F.concat(F.lit("input_identity:"), name)].eqNullSafe(observation["return_identity"])
    again = F.forall(related, lambda r: r["return"].eqNullSafe(observation["return"]))
    actual = observation[F.coalesce(oracle.channel, F.lit("return"))]
    return (
        F.when(~yes(oracle.active), unknown("oracle_not_active"))
        .when(oracle.kind == "equality", verdict(actual.eqNullSafe(oracle.expected), "equality"))
        .when(oracle.kind == "exception", verdict(raised, "exception_type_message_phase"))
        .when((oracle.kind == "preservation") & baseline.isNull(), unknown("missing_baseline"))
        .when(oracle.kind == "preservation", verdict(kept, "baseline_differential"))
        .when((oracle.kind == "input_identity") & ~yes(F.map_contains_key(inputs, name)), unknown("missing_input_identity"))
        .when(oracle.kind == "input_identity", verdict(same, "input_identity"))
        .when((oracle.kind == "idempotence") & (F.coalesce(F.size(related), F.lit(0)) < 1), unknown("missing_related_trace"))
        .when(oracle.kind == "idempotence", verdict(again, "idempotence"))
        .otherwise(unknown("unsupported_oracle_relation"))
    )


def classify_pair(base: Column, patch: Column, scenario_kind: Column, required: Column, active: Column, base_verdict: Column, patch_verdict: Column) -> Column:
    """struct(status, reason, origin, comparable) of a base run and a patched one.

    base, patch: structs with environment, setup_failure, dependency_failure, global_timeout, observation_reached,
    mechanical_failure and channels (map). required: array of channels. The verdicts: structs of evaluate_oracle, for a
    preservation scenario against the base run's own channels.
    """
    out = lambda status, reason, origin, comparable: F.struct(status.alias("status"), F.lit(reason).alias("reason"), origin.alias("origin"), F.lit(comparable).alias("comparable"))
    unknown = lambda reason, origin, comparable=False: out(F.lit("UNKNOWN"), reason, F.lit(origin), comparable)
    final = lambda reason, origin: out(patch_verdict["status"], reason, F.when(patch_verdict["status"] == "FAIL", origin).otherwise("NONE"), True)
    both = lambda name: yes(base[name]) & yes(patch[name])
    has = lambda run, c: yes(F.map_contains_key(run["channels"], c))
    has_all = lambda run: F.forall(required, lambda c: has(run, c))
    target, keeps = scenario_kind == "TARGET", scenario_kind == "PRESERVATION"
    base_fails = (base_verdict["status"] == "FAIL") | ~has_all(base)
    return (
        F.when(~base["environment"].eqNullSafe(patch["environment"]), unknown("environment_mismatch", "ENVIRONMENT"))
        .when(both("setup_failure") | both("dependency_failure") | both("global_timeout"), unknown("shared_nonbehavioral_failure", "SHARED_SETUP_OR_DEPENDENCY"))
        .when(~yes(base["observation_reached"]), unknown("invalid_base_scenario", "SCENARIO"))
        .when(yes(patch["mechanical_failure"]) & ~yes(base["mechanical_failure"]), out(F.lit("FAIL"), "patch_specific_mechanical", F.lit("PATCH_MECHANICAL"), True))
        .when(target & ~yes(active), unknown("oracle_not_active", "ORACLE"))
        .when(target & ~has_all(patch), unknown("patch_observation_channel_missing", "OBSERVATION_SCHEMA"))
        .when(target & ~yes(base_fails), unknown("base_precondition_false", "SCENARIO_PRECONDITION", True))
        .when(target, final("target_predicate", "TARGET_BEHAVIOR"))
        .when(~yes(keeps), unknown("unsupported_scenario_kind", "SCENARIO"))
        .when(F.exists(required, lambda c: has(base, c) != has(patch, c)), unknown("observation_not_comparable", "OBSERVATION_SCHEMA"))
        .when(base_verdict["status"] != "PASS", unknown("preservation_not_established", "BASELINE", True))
        .otherwise(final("preservation_predicate", "PRESERVATION"))
    )


def contest(evidence: Column, more: Column) -> Column:
    """A contested oracle's columns: it no longer runs, and its evidence is the sorted union."""
    return F.struct(F.lit("CONTESTED").alias("lifecycle"), F.lit(False).alias("executable"), F.array_sort(F.array_union(evidence, more)).alias("evidence"))


#: Decision, then lifecycle and whether it runs.
ADJUDICATION = {"restore": ("ACTIVE", True), "narrow": ("ACTIVE", True), "downgrade": ("DOWNGRADED", False), "revoke": ("REVOKED", False)}


def adjudicate(decision: Column, relation: Column, narrowed: Column) -> Column:
    """struct(lifecycle, executable, relation); null for an unknown decision, and for a narrowing without a relation."""
    out = F
    for name, (lifecycle, runs) in ADJUDICATION.items():
        fits = decision == name if name != "narrow" else (decision == name) & (F.coalesce(F.length(narrowed), F.lit(0)) > 0)
        out = out.when(fits, F.struct(F.lit(lifecycle).alias("lifecycle"), F.lit(runs).alias("executable"), (narrowed if name == "narrow" else relation).alias("relation")))
    return out
