"""Challenges of a diff: which exits a changed relation has, which challenge counts, and whether the diff is closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import TRUSTED, yes

#: Pattern of the relation's kind, handler, kind of exit, and (partition, expected exit). First match wins.
HANDLERS = [
    ("guard_(?:added|modified|deleted)", "changed_guard", "guard", [("true", "true"), ("false", "false"), ("boundary", "boundary")]),
    ("call_(?:added|modified|deleted)", "call_exits", "call_exit", [("normal", "normal"), ("exception", "exception")]),
    ("fallback_deleted|return_(?:added|modified|deleted)", "fallback_return", "fallback", [("predecessor", "former_fallback")]),
    ("state_(?:added|modified|deleted)", "state_lifecycle", "state", [("predecessor", "predecessor"), ("successor", "successor"), ("repeated", "repeated"), ("recovery", "recovery")]),
    ("dispatch_(?:added|modified|deleted)", "protocol_dispatch", "dispatch", [(x, x) for x in ("left_right", "right_left", "not_implemented_fallback", "truthy", "falsy", "empty", "nonempty")]),
    ("resource_(?:added|modified|deleted)", "resource_lifetime", "resource", [("normal_release", "normal_release"), ("exception_release", "exception_release")]),
    ("external_effect_(?:added|modified)|external_surface_modified", "external_effect", "external_effect", [("before", "before"), ("after", "after")]),
    ("assignment_(?:added|modified|deleted)", "alias_flow", "alias_flow", [("direct", "consumer"), ("aliased", "consumer")]),
]
UNSTABLE = ["SAME_INFRA_FAILURE", "NEW_INFRA_FAILURE", "UNSUPPORTED_CHECK", "FLAKY_RESULT"]


def relation_exits(relations: DataFrame) -> DataFrame:
    """relation, handler, kind, partition, constraints, expected_exit: the exits of each changed relation.

    relations: relation, change, predicate. Changes that no handler takes give no rows; a guard without a predicate has
    the predicate True.
    """
    predicate = F.coalesce(F.nullif("predicate", F.lit("")), F.lit("True"))
    none = F.array().cast("array<string>")
    out = F
    for pattern, handler, kind, exits in HANDLERS:
        constraints = lambda part: none if part not in ("true", "false") else F.array(predicate if part == "true" else F.concat(F.lit("not ("), predicate, F.lit(")")))
        rows = [F.struct(F.lit(handler).alias("handler"), F.lit(kind).alias("kind"), F.lit(p).alias("partition"), constraints(p).alias("constraints"), F.lit(e).alias("expected_exit")) for p, e in exits]
        out = out.when(F.col("change").rlike(f"^(?:{pattern})$"), F.array(*rows))
    return relations.select("relation", F.inline(out.otherwise(None)))


def evaluate_dicc(diffs: DataFrame, targets: DataFrame, comparisons: DataFrame, uncovered: DataFrame, challenges: DataFrame) -> DataFrame:
    """A certificate per diff: status, reason, counts and sorted ids.

    diffs: diff, path_obligations, active_bindings, real_challenges. targets: diff, check_id. comparisons: diff,
    comparison, check_id, class. uncovered: diff, partition. challenges: diff, challenge (executed ones). Empty tables
    and missing rows count as none.
    """
    wanted = targets.where("check_id <> ''").select("diff", "check_id").distinct().withColumn("target", F.lit(True))
    paired = comparisons.join(wanted, ["diff", "check_id"], "left").withColumn("target", yes(F.col("target")))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("check_id"))))
    cls = lambda *names: F.col("class").isin(*names)
    by = paired.groupBy("diff").agg(
        F.count_if("target").alias("pairs"),
        ids(F.col("target") & cls("TARGET_STILL_FAILING", "TARGET_REGRESSED")).alias("stable_failures"),
        ids(cls("PRESERVATION_REGRESSION")).alias("regressions"),
        ids(cls(*UNSTABLE)).alias("environment"),
        F.count_if(F.col("target") & ~cls("TARGET_FIXED")).alias("unfixed"),
    )
    own = paired.where("target").select("diff", F.concat(F.lit("target-comparison:"), F.col("comparison").cast("string")).alias("challenge"))
    executed = own.unionByName(challenges.select("diff", F.col("challenge").cast("string").alias("challenge"))).groupBy("diff").agg(F.array_sort(F.collect_set("challenge")).alias("executed"))
    parts = uncovered.groupBy("diff").agg(F.array_sort(F.collect_list("partition")).alias("uncovered"))
    counts = targets.groupBy("diff").agg(F.count("*").alias("n_targets"))
    rows = diffs
    for t in (counts, by, executed, parts):
        rows = rows.join(t, "diff", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    real = n("pairs") + n("real_challenges")
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(n("n_targets") == 0, said("NOT_EVALUABLE", "no executable target"))
        .when(n("path_obligations") <= 0, said("NOT_EVALUABLE", "no executable requirement path obligation"))
        .when(n("active_bindings") <= 0, said("NOT_EVALUABLE", "no active executable binding"))
        .when(n("pairs") == 0, said("NOT_EVALUABLE", "no real target execution"))
        .when(some("environment"), said("BLOCKED_EXTERNAL", "required check environment is unavailable or unstable"))
        .when(some("stable_failures"), said("OPEN", "stable target failure remains"))
        .when(some("regressions"), said("OPEN", "preservation regression remains"))
        .when(some("uncovered"), said("OPEN", "touched branch partition is uncovered"))
        .when(n("unfixed") > 0, said("OPEN", "not every target is fixed"))
        .when(real == 0, said("NOT_EVALUABLE", "no real challenge execution"))
        .otherwise(said("CLOSED", "all executable targets and required impact checks passed"))
    )
    listed = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    rows = rows.withColumn("v", verdict)
    types = {f.name: f.dataType for f in rows.schema}
    return rows.select("diff", "v.status", "v.reason", n("n_targets").alias("targets"), n("pairs").alias("target_executions"), real.alias("challenge_executions"), *[listed(c, types[c]) for c in ("stable_failures", "regressions", "environment", "uncovered", "executed")])


def is_confirmed(cell_status: Column, authority: Column, executable: Column, stability: Column, base_runs: Column, patch_runs: Column, base_outcome: Column, patch_outcome: Column, bound: Column) -> Column:
    """A challenge that passed before and fails after, twice and stable, under a trusted oracle, in bound code."""
    twice = yes(base_runs >= 2) & yes(patch_runs >= 2) & yes(stability == "STABLE")
    return yes(cell_status == "FAIL") & yes(authority.isin(TRUSTED)) & yes(executable) & twice & yes(base_outcome == "PASS") & yes(patch_outcome == "FAIL") & yes(bound)


def admit(unit_oracle: Column, locked_oracle: Column, scenario_oracle: Column, active: Column, unresolved: Column, recipe_fault: Column, observation: Column) -> Column:
    """struct(admitted, reason) of a proposed scenario. recipe_fault: what the recipe's validation says, or null."""
    no = lambda reason: F.struct(F.lit(False).alias("admitted"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return (
        F.when(~unit_oracle.eqNullSafe(locked_oracle), no("oracle_not_locked_to_binding"))
        .when(~scenario_oracle.eqNullSafe(locked_oracle), no("scenario_changed_locked_oracle"))
        .when(~yes(active), no("oracle_not_active_ABC"))
        .when(F.coalesce(unresolved, F.lit(0)) > 0, no("proposal_has_unresolved_fields"))
        .when(recipe_fault.isNotNull(), no(F.concat(F.lit("recipe_rejected:"), recipe_fault)))
        .when(F.coalesce(observation, F.lit("")) == "", no("observation_channel_missing"))
        .otherwise(F.struct(F.lit(True).alias("admitted"), F.lit("admitted").alias("reason")))
    )


def symbols_overlap(executed: Column, bound: Column) -> Column:
    """Equal, one the dotted tail of the other, or both dotted with the same last part. Empty names overlap nothing."""
    tail = lambda a, b: F.endswith(a, F.concat(F.lit("."), b))
    last = lambda c: F.substring_index(c, ".", -1)
    dotted = F.contains(executed, F.lit(".")) & F.contains(bound, F.lit("."))
    return yes((executed != "") & (bound != "") & ((executed == bound) | tail(executed, bound) | tail(bound, executed) | (dotted & (last(executed) == last(bound)))))


def check_binds_requirement(requirement: Column, requirement_evidence: Column, check_requirements: Column, check_evidence: Column, oracle_requirement: Column, executed: Column, bound: Column) -> Column:
    """By name, by shared evidence, by an executed symbol that a bound one overlaps, or by the oracle. Arrays; null is
    empty. Executed and bound symbols meet inside one row, by equality of names or of dotted tails."""
    met = F.exists(executed, lambda e: F.exists(bound, lambda b: symbols_overlap(e, b)))
    return yes(F.array_contains(check_requirements, requirement)) | yes(F.arrays_overlap(check_evidence, requirement_evidence)) | yes(met) | yes(oracle_requirement == requirement)


def changed_nodes(nodes: DataFrame, hunks: DataFrame, reach: int = 256) -> DataFrame:
    """node: nodes whose lines a hunk of their file touches. nodes: node, file, line, end_line; hunks: file, new_start,
    new_count. Hunks and nodes are cut into buckets of `reach` lines, so a hot file isn't compared all with all."""
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    end = F.coalesce("end_line", "line")
    n = nodes.where("line is not null").select("node", "file", "line", end.alias("end")).where("line <= end").withColumn("bucket", bucket(F.col("line"), F.col("end")))
    h = hunks.select("file", F.col("new_start").alias("lower"), (F.col("new_start") + F.greatest("new_count", F.lit(1)) - 1).alias("upper")).withColumn("bucket", bucket(F.col("lower"), F.col("upper")))
    return n.join(h, ["file", "bucket"]).where("line <= upper and end >= lower").select("node").distinct()
