"""Gates over a state's outcomes, checks and frontiers: what forbids a patch, and when a target is reached.

Tables are keyed by `state`. A state without rows in a table has none of these things; null booleans count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
TRUSTED = ["A", "B", "C"]
INVALID_CLASSES = ["SAME_INFRA_FAILURE", "NEW_INFRA_FAILURE", "FLAKY_RESULT", "UNSUPPORTED_CHECK"]
TERMINAL = ["NO_LEGAL_ACTION", "ENVIRONMENT_BLOCKED", "SEMANTIC_BLOCKED", "ORACLE_BLOCKED", "LOCALIZATION_BLOCKED", "GENERATOR_BLOCKED_EXTERNAL", "GENERATOR_NONPROGRESS", "MECHANICAL_FAILURE"]


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def hard_frontiers(*frontiers: DataFrame) -> DataFrame:
    """state, frontier: the open hard ones of several graphs' tables (state, frontier, hard, status), each once."""
    out = None
    for f in frontiers:
        open_ = f.where("hard and status = 'OPEN'").select("state", "frontier")
        out = open_ if out is None else out.unionByName(open_)
    return out.distinct()


def raw_avoid_reasons(states: DataFrame, old: DataFrame, new: DataFrame, mechanical: DataFrame) -> DataFrame:
    """state, reasons (sorted, each once).

    states: state, forbidden_edit, oracle_contamination. old, new: state, seq, challenge, kind, status, stable; of new
    outcomes with one challenge the last by seq counts. mechanical: state, status.
    """
    broken = mechanical.where("status <> 'PASS'").select("state").distinct().withColumn("broken", F.lit(True))
    passed = old.where("status = 'PASS' and challenge is not null").select("state", "challenge").distinct()
    latest = new.where("challenge is not null").groupBy("state", "challenge").agg(F.max_by("status", "seq").alias("now"))
    lost = passed.join(latest, ["state", "challenge"], "left").where("now is null or now <> 'PASS'").select("state").distinct().withColumn("lost", F.lit(True))
    harmed = new.where("kind = 'PRESERVATION' and status = 'FAIL' and stable").select("state").distinct().withColumn("harmed", F.lit(True))
    rows = states.join(broken, "state", "left").join(lost, "state", "left").join(harmed, "state", "left")
    label = lambda c, name: F.when(yes(F.col(c)), name)
    reasons = [label("broken", "MECHANICAL_FAILURE"), label("forbidden_edit", "FORBIDDEN_EDIT"), label("oracle_contamination", "ORACLE_CONTAMINATION"), label("lost", "ESTABLISHED_SUCCESS_LOST"), label("harmed", "PRESERVATION_FAILURE")]
    return rows.select("state", F.array_sort(F.array_compact(F.array(*reasons))).alias("reasons"))


def trusted_targets(targets: DataFrame) -> DataFrame:
    """targets: state, check_id, tier, has_candidate, certified."""
    return targets.where(F.col("tier").isin(TRUSTED) & yes(F.col("has_candidate")) & yes(F.col("certified"))).select("state", "check_id").distinct()


def in_target_set(states: DataFrame, targets: DataFrame, comparisons: DataFrame, counterexamples: DataFrame, coverage: DataFrame) -> DataFrame:
    """state, reached: every trusted target is fixed by its comparison, and nothing else forbids it.

    states: state, has_diff, safe, confirmed_failures, fallback_used. comparisons: state, check_id, class, signature (of
    the patched run). counterexamples: state, environment_valid, signature. coverage: state, status, bound (has units and
    checks).
    """
    trusted = trusted_targets(targets)
    wanted = trusted.groupBy("state").agg(F.count("*").alias("targets"))
    paired = comparisons.join(trusted, ["state", "check_id"], "left_semi").groupBy("state").agg(F.count("*").alias("paired"), F.every(F.col("class") == "TARGET_FIXED").alias("fixed"))
    harmed = comparisons.groupBy("state").agg(F.bool_or(F.col("class") == "PRESERVATION_REGRESSION").alias("harmed"))
    live = comparisons.where("signature <> ''").select("state", "signature").distinct()
    again = counterexamples.where("environment_valid and signature <> ''").join(live, ["state", "signature"], "left_semi").select("state").distinct().withColumn("again", F.lit(True))
    open_rows = coverage.where("bound").groupBy("state").agg(F.every(F.col("status") == "PASSING").alias("covered"))
    rows = states
    for part in (wanted, paired, harmed, again, open_rows):
        rows = rows.join(part, "state", "left")
    reached = (
        yes(F.col("has_diff")) & yes(F.col("targets") > 0) & yes(F.col("paired") == F.col("targets")) & yes(F.col("fixed"))
        & ~yes(F.col("harmed")) & ~yes(F.col("again")) & yes(F.col("safe")) & (F.coalesce("confirmed_failures", F.lit(0)) == 0)
        & ~yes(F.col("fallback_used")) & F.coalesce("covered", F.lit(True))
    )
    return rows.select("state", reached.alias("reached"))


def in_target_set_by_units(states: DataFrame, units: DataFrame, outcomes: DataFrame, public_evidence: DataFrame) -> DataFrame:
    """state, reached, where no target recovery ran: target units pass or have public evidence, preservation units pass.

    states: state, has_diff, safe, diff_closed, hashes_current, public_failures, pending (counts). units: state, unit,
    is_target, is_preservation. outcomes: state, unit, status, stable. public_evidence: state, unit.
    """
    by_unit = outcomes.groupBy("state", "unit").agg(F.every(F.col("status") == "PASS").alias("ok"))
    public = public_evidence.select("state", "unit").distinct().withColumn("public", F.lit(True))
    known = units.join(by_unit, ["state", "unit"], "left").join(public, ["state", "unit"], "left")
    sums = known.groupBy("state").agg(
        F.count_if("is_target").alias("n_targets"),
        F.every(~yes(F.col("is_target")) | yes(F.col("ok")) | yes(F.col("public"))).alias("targets_pass"),
        F.every(~yes(F.col("is_preservation")) | yes(F.col("ok"))).alias("kept"),
    )
    failing = outcomes.where("status = 'FAIL' and stable").select("state").distinct().withColumn("failing", F.lit(True))
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    reached = (
        yes(F.col("has_diff")) & yes(F.col("safe")) & yes(F.col("n_targets") > 0) & yes(F.col("targets_pass")) & yes(F.col("kept")) & ~yes(F.col("failing"))
        & none("public_failures") & yes(F.col("diff_closed")) & yes(F.col("hashes_current")) & none("pending")
    )
    return states.join(sums, "state", "left").join(failing, "state", "left").select("state", reached.alias("reached"))


def evidence_limited_complete(states: DataFrame, targets: DataFrame, comparisons: DataFrame) -> DataFrame:
    """state, complete: a safe kept patch with no trusted target to hold it against. states: state, has_diff,
    has_recovery, safe, confirmed_failures, patch_status."""
    trusted = trusted_targets(targets).select("state").distinct().withColumn("trusted", F.lit(True))
    harmed = comparisons.where("class = 'PRESERVATION_REGRESSION'").select("state").distinct().withColumn("harmed", F.lit(True))
    rows = states.join(trusted, "state", "left").join(harmed, "state", "left")
    kept = ~F.coalesce("patch_status", F.lit("")).isin("ROLLED_BACK", "EMPTY")
    done = yes(F.col("has_diff")) & yes(F.col("has_recovery")) & ~yes(F.col("trusted")) & (F.coalesce("confirmed_failures", F.lit(0)) == 0) & yes(F.col("safe")) & kept & ~yes(F.col("harmed"))
    return rows.select("state", done.alias("complete"))


def terminal_avoid_reason(budget_left: Column, reached: Column, has_diff: Column, safe: Column, confirmed_failures: Column, termination: Column) -> Column:
    """Why a state ends; null if it goes on."""
    spent = ~yes(budget_left) & ~yes(reached)
    return (
        F.when(spent & yes(has_diff) & yes(safe) & (F.coalesce(confirmed_failures, F.lit(0)) == 0), F.lit(None).cast("string"))
        .when(spent & yes(has_diff), "REVISION_BUDGET_EXHAUSTED_WITH_UNCERTIFIED_PATCH")
        .when(spent, "REVISION_BUDGET_EXHAUSTED_WITH_TARGET_FAILURE")
        .when(termination.isin(TERMINAL), termination)
    )


def should_commit(real_executions: Column, new_regressions: Column, safe: Column, *gains: Column) -> Column:
    """gains: targets fixed, deficit reduced, counterexamples eliminated, risky unknowns reduced."""
    n = lambda c: F.coalesce(c, F.lit(0))
    gained = F.lit(False)
    for g in gains:
        gained = gained | (n(g) > 0)
    return (n(real_executions) > 0) & (n(new_regressions) <= 0) & yes(safe) & gained


def decide_execution_transition(new_regressions: Column, safe: Column, blocked: Column, commits: Column) -> Column:
    """Regressions, or a trial that is unsafe for another reason than its environment, roll back."""
    bad = (F.coalesce(new_regressions, F.lit(0)) > 0) | (~yes(safe) & ~yes(blocked))
    return F.when(bad, "ROLLBACK").when(yes(blocked), "KEEP_UNCERTIFIED").when(yes(commits), "COMMIT").otherwise("ROLLBACK")
