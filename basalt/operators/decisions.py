"""Row-to-label rules: paired check results, transitions, authority, coverage and closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_check_pair(base: Column, patch: Column, base_stable: Column, patch_stable: Column, role: Column) -> Column:
    """Nine classes; infrastructure first, then flakiness, then what the role makes of pass and fail."""
    pair = lambda a, b: (base == a) & (patch == b)
    shaky = ~base_stable | ~patch_stable | (base == "FLAKY") | (patch == "FLAKY")
    return (
        F.when((base == "UNSUPPORTED") | (patch == "UNSUPPORTED") | (base == "INVALID_SELECTOR"), "UNSUPPORTED_CHECK")
        .when(base == "INVALID_ENVIRONMENT", "SAME_INFRA_FAILURE")
        .when(patch.isin("INVALID_ENVIRONMENT", "INVALID_SELECTOR"), "NEW_INFRA_FAILURE")
        .when(shaky, "FLAKY_RESULT")
        .when((role == "PRESERVATION") & pair("PASS", "FAIL"), "PRESERVATION_REGRESSION")
        .when(pair("PASS", "PASS"), "PASS_PRESERVED")
        .when(pair("FAIL", "FAIL"), "TARGET_STILL_FAILING")
        .when(pair("FAIL", "PASS"), "TARGET_FIXED")
        .when(pair("PASS", "FAIL"), "TARGET_REGRESSED")
        .otherwise("FLAKY_RESULT")
    )


def compare_checks(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """before, after: key, role, status, stable. Both sides of each check, with its class; one-sided checks are absent."""
    b, a = before.alias("b"), after.alias("a")
    label = classify_check_pair(F.col("b.status"), F.col("a.status"), F.col("b.stable"), F.col("a.stable"), F.col("b.role"))
    return b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).select(F.col(f"b.{key}").alias(key), F.col("b.role").alias("role"), F.col("b.status").alias("baseline"), F.col("a.status").alias("patched"), label.alias("class"))


def progress_vector(classed: DataFrame, by: list[str]) -> DataFrame:
    count = lambda *names: F.count_if(F.col("class").isin(*names))
    return classed.groupBy(*by).agg(
        count("TARGET_FIXED").alias("fixed"),
        count("TARGET_REGRESSED", "PRESERVATION_REGRESSION").alias("regressed"),
        count("TARGET_STILL_FAILING").alias("still_failing"),
        count("PASS_PRESERVED").alias("preserved"),
        count("FLAKY_RESULT", "SAME_INFRA_FAILURE", "NEW_INFRA_FAILURE", "UNSUPPORTED_CHECK").alias("unknown"),
    )


#: Which strategies give which tier.
TIER_B = ["issue_executable_witness", "return_or_exception_api_contract"]
TIER_C = ["metamorphic_relation", "baseline_differential_relation", "object_state_or_protocol_relation", "serialization_or_rendering"]
PUBLIC = ["PUBLIC", "PUBLIC_REPOSITORY_TEST", "PUBLIC_EXPLICIT_COMMAND"]


def authority_tier(strategy: Column, candidate: Column, authority: Column, evidence: Column) -> Column:
    letters = ["A", "B", "C", "D", "E"]
    text = F.lower(evidence)
    return (
        F.when(F.upper(candidate).isin(letters), F.upper(candidate))
        .when((strategy == "llm_reproduction") | text.contains("directed-public-reproduction"), "E")
        .when(strategy.isin(TIER_B), "B")
        .when(strategy.isin(TIER_C), "C")
        .when(F.upper(authority).isin(letters), F.upper(authority))
        .when(F.upper(authority).isin(PUBLIC), "A")
        .when(text.contains("issue-code-block") | text.contains("issue-behavior"), "B")
        .otherwise("E")
    )


def coverage_status(statuses: Column) -> Column:
    """A requirement's status from the set of its units' statuses."""
    has = lambda s: F.array_contains(statuses, s)
    return (
        F.when(has("PRESERVATION_RISK"), "PRESERVATION_RISK")
        .when(has("FAILING") | has("COUNTEREXAMPLE_OPEN"), "FAILING")
        .when((F.size(statuses) == 1) & has("PASSING"), "PASSING")
        .when(has("UNBOUND"), "UNBOUND")
        .when((F.size(statuses) > 0) & (F.size(F.array_except(statuses, F.array(F.lit("ORACLE_UNAVAILABLE"), F.lit("ENVIRONMENT_BLOCKED")))) == 0), "UNTESTABLE")
        .otherwise("UNKNOWN")
    )


def challenge_score(authority: Column, risk: Column, relevance: Column, gain: Column, cost: Column) -> Column:
    return authority * risk * relevance * gain / F.greatest(cost, F.lit(0.1))


#: What an outcome weighs in a losing core; 1 for any other, 3 for a unit without outcomes.
PRESSURE = {"FAIL": 4.0, "BLOCKED": 3.0, "UNKNOWN": 2.5, "FLAKY": 2.5, "UNKNOWN_EXECUTION": 2.5, "UNKNOWN_ORACLE": 2.0, "BLOCKED_EXTERNAL": 2.0, "UNSUPPORTED": 2.0}


def losing_components(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """component, pressure, units (losing ones): each losing unit adds its weight, its worst outcome's pressure, half a
    point per bypass and three quarters per frontier.

    units: component, unit, weight, bypasses, frontiers. outcomes: unit, status. A unit loses if it has no outcome, or one
    that isn't a pass.
    """
    rank = F
    for status, p in PRESSURE.items():
        rank = rank.when(F.col("status") == status, p)
    seen = outcomes.groupBy("unit").agg(F.max(rank.otherwise(1.0)).alias("worst"), F.every(F.col("status") == "PASS").alias("passes"))
    losing = units.join(seen, "unit", "left").where("passes is null or not passes")
    each = F.col("weight") + F.coalesce("worst", F.lit(3.0)) + F.coalesce("bypasses", F.lit(0)) * 0.5 + F.coalesce("frontiers", F.lit(0)) * 0.75
    return losing.groupBy("component").agg(F.round(F.sum(each), 6).alias("pressure"), F.count("*").alias("units"))


def partition_of(status: Column) -> Column:
    """passed, failed, blocked or unknown; UNKNOWN is never taken for a pass."""
    return F.when(status == "PASS", "passed").when(status == "FAIL", "failed").when(status.isin("BLOCKED", "BLOCKED_EXTERNAL"), "blocked").otherwise("unknown")
