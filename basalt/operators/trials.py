"""Locked trials: one set of checks run before and after a patch, what changed, and whose word counts.

Runs are rows (trial, check_id, status, stable); a locked set is (trial, check_id, role), the role one of TARGET,
COUNTEREXAMPLE, PRESERVATION, MECHANICAL; a check may have several roles. Null booleans count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import TRUSTED, yes

#: Fixed values. Five statuses say nothing of a trial; the classifier's own list has three.
UNTELLING = ["TIMEOUT", "FLAKY", "INVALID_ENVIRONMENT", "INVALID_SELECTOR", "UNSUPPORTED"]
CONFIRMED_KINDS = {"CONFIRMED_MECHANICAL_FAILURE": 4, "CONFIRMED_PRESERVATION_REGRESSION": 3, "CONFIRMED_TARGET_FAILURE": 2, "CONFIRMED_DICC_COUNTEREXAMPLE": 1}
MARKERS = [
    "modulenotfounderror", "no module named", "command not found", "collected 0 items", "no tests ran", "ran 0 tests",
    "settings are not configured", "requested setting ", "settings.databases is improperly configured",
    "database settings are improperly configured", "please supply the name value", "appregistrynotready",
    "apps aren't loaded yet", "could not connect", "connection refused", "temporary failure in name resolution",
    "database backend is required", "permission denied", "read-only file system", "no space left on device",
]


def observations_are_comparable(before: Column, after: Column) -> Column:
    """before, after: structs with check_id, status, stable; null where there is no run."""
    tells = lambda run: yes(run["stable"]) & ~run["status"].isin(UNTELLING)
    return yes(before.isNotNull() & after.isNotNull() & (before["check_id"] == after["check_id"]) & tells(before) & tells(after))


def is_confirmed_failure(kind: Column, authority: Column, stable_runs: Column, executable: Column, comparable: Column) -> Column:
    return yes(kind.isin(list(CONFIRMED_KINDS))) & yes(authority.isin(TRUSTED)) & yes(stable_runs >= 2) & yes(executable) & yes(comparable)


def failure_rank(kind: Column) -> Column:
    out = F
    for name, rank in CONFIRMED_KINDS.items():
        out = out.when(kind == name, rank)
    return out.otherwise(0)


def select_confirmed_failure(failures: DataFrame, by: str) -> DataFrame:
    """by, failure: of the confirmed ones the kind that weighs most, then the greatest id. failures: by, failure, kind,
    authority, stable_runs, executable, comparable."""
    held = failures.where(is_confirmed_failure(*[F.col(c) for c in ("kind", "authority", "stable_runs", "executable", "comparable")]))
    return held.groupBy(by).agg(F.max(F.struct(failure_rank(F.col("kind")).alias("rank"), "failure")).alias("x")).select(by, F.col("x.failure").alias("failure"))


def compare_observations(locked: DataFrame, before: DataFrame, after: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row per trial of the locked set: sorted id lists and whether the two sides can be compared.

    A check that ran on one side only, or outside the locked set, makes the trial incomparable. baseline: trial, check_id,
    status: what preservation checks gave when they were locked; only those that passed can regress.
    """
    side = lambda df, name: df.select("trial", "check_id", F.struct("check_id", "status", "stable").alias(name))
    roles = locked.groupBy("trial", "check_id").agg(F.collect_set("role").alias("roles"))
    rows = side(before, "b").join(side(after, "a"), ["trial", "check_id"], "full").join(roles, ["trial", "check_id"], "full")
    rows = rows.join(baseline.select("trial", "check_id", F.col("status").alias("was")), ["trial", "check_id"], "left")
    is_locked = F.col("roles").isNotNull()
    role = lambda *names: yes(F.arrays_overlap("roles", F.array(*map(F.lit, names))))
    ids = lambda condition: F.array_sort(F.collect_set(F.when(yes(condition), F.col("check_id"))))
    target, keeps, mechanical = role("TARGET", "COUNTEREXAMPLE"), role("PRESERVATION") & (F.col("was") == "PASS"), role("MECHANICAL")
    silent = lambda run: run.isNull() | run["status"].isin(UNTELLING) | ~yes(run["stable"])
    now = lambda run, status: F.col(run)["status"] == status
    out = rows.groupBy("trial").agg(
        F.every(is_locked & observations_are_comparable(F.col("b"), F.col("a"))).alias("paired"),
        ids(target & now("b", "PASS")).alias("target_pass_before"),
        ids(target & now("a", "PASS")).alias("target_pass_after"),
        ids(target & now("b", "FAIL")).alias("target_fail_before"),
        ids(target & now("a", "FAIL")).alias("target_fail_after"),
        ids(keeps & now("b", "FAIL")).alias("regressions_before"),
        ids(keeps & now("a", "FAIL")).alias("regressions_after"),
        ids(mechanical & now("b", "FAIL")).alias("mechanical_before"),
        ids(mechanical & now("a", "FAIL")).alias("mechanical_after"),
        ids(is_locked & (silent(F.col("b")) | silent(F.col("a")))).alias("unknown"),
        F.count_if(is_locked).alias("n_locked"),
    )
    comparable = F.col("paired") & (F.col("n_locked") > 0) & (F.size("unknown") == 0)
    return out.select("trial", comparable.alias("comparable"), *[c for c in out.columns if c not in ("trial", "paired", "n_locked")])


def decide(comparison: DataFrame) -> DataFrame:
    """trial, decision, reason of compare_observations' rows."""
    n = lambda c: F.size(c)
    target = n("target_pass_after") > n("target_pass_before")
    fewer = (n("target_pass_after") == n("target_pass_before")) & (n("regressions_before") > n("regressions_after"))
    healthier = (n("mechanical_before") > n("mechanical_after")) & (n("mechanical_after") == 0)
    said = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
    clean = (n("regressions_after") == 0) & (n("mechanical_after") == 0)
    verdict = (
        F.when(~F.col("comparable") | (n("unknown") > 0), said("ROLLBACK", "LOCKED_CHECK_RESULTS_NOT_COMPARABLE"))
        .when(target & (n("regressions_after") > 0), said("KEEP_TRIAL_FOR_REGRESSION_REPAIR", "TARGET_FIXED_WITH_CONFIRMED_PRESERVATION_REGRESSION"))
        .when((target | fewer) & clean, said("PROMOTE", "CONFIRMED_EXECUTION_IMPROVEMENT"))
        .when(healthier & clean, said("PROMOTE", "CONFIRMED_MECHANICAL_HEALTH_IMPROVEMENT"))
        .otherwise(said("ROLLBACK", "NO_CONFIRMED_IMPROVEMENT"))
    )
    return comparison.withColumn("v", verdict).select("trial", "v.decision", "v.reason")


def trial_progress(comparison: DataFrame) -> DataFrame:
    """Deltas of one revision; all 0 where the trial can't be compared."""
    told = F.col("comparable") & (F.size("unknown") == 0)
    delta = lambda a, b: F.when(told, F.size(a) - F.size(b)).otherwise(0).cast("long")
    return comparison.select(
        "trial",
        delta("target_pass_after", "target_pass_before").alias("target_pass_delta"),
        delta("target_fail_after", "target_fail_before").alias("target_failure_delta"),
        delta("regressions_after", "regressions_before").alias("regression_delta"),
        delta("target_fail_after", "target_fail_before").alias("counterexample_delta"),
        delta("mechanical_before", "mechanical_after").alias("mechanical_health_delta"),
        F.when(told, F.size(F.array_except("target_pass_after", "target_pass_before"))).otherwise(0).cast("long").alias("requirement_delta"),
    )


def evidence_vector(comparison: DataFrame) -> DataFrame:
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return comparison.select("trial", n("target_pass_after", "target_passes"), n("target_fail_after", "target_failures"), n("regressions_after", "regressions"), n("mechanical_after", "mechanical_failures"))


def progress_from_comparisons(previous: DataFrame, current: DataFrame, by: str) -> DataFrame:
    """Deltas between two sets of paired checks: by, check_id, class, baseline, baseline_stable, baseline_signature,
    patched, patched_stable, patched_signature. Pairs that can't be compared don't count; with none now, all is 0.
    Signatures are '' or null where nothing failed."""
    tells = lambda s: yes(F.col(f"{s}_stable")) & ~F.col(s).isin(UNTELLING)
    kept = lambda df: df.where(tells("baseline") & tells("patched"))
    cls = lambda *names: F.col("class").isin(*names)
    open_, worse = cls("TARGET_STILL_FAILING", "TARGET_REGRESSED"), cls("TARGET_REGRESSED", "PRESERVATION_REGRESSION")
    ids = lambda c: F.collect_set(F.when(c, F.col("check_id")))
    signs = lambda c, s: F.collect_set(F.when(c & (F.col(s) != ""), F.col(s)))
    old = kept(previous).groupBy(by).agg(ids(cls("TARGET_FIXED")).alias("old_fixed"), ids(open_).alias("old_open"), signs(cls("TARGET_STILL_FAILING"), "patched_signature").alias("old_signs"), F.count_if(worse).alias("old_worse"))
    new = kept(current).groupBy(by).agg(
        ids(cls("TARGET_FIXED")).alias("fixed"), ids(open_).alias("open"), signs(cls("TARGET_STILL_FAILING"), "patched_signature").alias("signs"), F.count_if(worse).alias("worse"),
        ids(F.col("baseline") == "FAIL").alias("failed_first"), signs(F.col("baseline") == "FAIL", "baseline_signature").alias("first_signs"),
    )
    rows = new.join(old, by, "left")
    none = F.array().cast("array<string>")
    old_fixed = F.coalesce("old_fixed", F.array().cast(new.schema["fixed"].dataType))
    n = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        by,
        n(F.size("fixed") - F.size(old_fixed), "target_pass_delta"),
        n(F.size("open") - F.size(F.coalesce("old_open", "failed_first")), "target_failure_delta"),
        n(F.col("worse") - F.coalesce("old_worse", F.lit(0)), "regression_delta"),
        n(F.size(F.coalesce("signs", none)) - F.size(F.coalesce("old_signs", "first_signs")), "counterexample_delta"),
        n(F.size(F.array_except("fixed", old_fixed)), "requirement_delta"),
    )


def candidate_authority(explicit: Column, fallback: Column, strategy: Column, baseline_status: Column) -> Column:
    """A, B, C, E or UNTRUSTED: the letter that is given, else what the strategy is worth."""
    given = F.upper(F.coalesce(F.nullif(explicit, F.lit("")), fallback))
    how = F.lower(strategy)
    return (
        F.when(given.isin(TRUSTED), given)
        .when(how == "llm_reproduction", "E")
        .when(how.isin("related_public_test", "public_repository_test") & (baseline_status == "FAIL"), "A")
        .when(how.isin("issue_executable_witness", "return_or_exception_api_contract"), "B")
        .when(how.isin("baseline_differential_relation", "object_state_or_protocol_relation"), "C")
        .otherwise("UNTRUSTED")
    )


def target_catalog(candidates: DataFrame, targets: DataFrame, executions: DataFrame) -> DataFrame:
    """check_id, authority, strategy, stable, baseline_status, trusted, certified; the last recovery that names a target
    counts.

    candidates: recovery, check_id, explicit, fallback, strategy, expected_baseline, n_symbols. targets: recovery,
    check_id, n_requirements. executions: recovery, check_id, status, stable. Recoveries are numbered in order.
    """
    last = candidates.where("check_id <> ''").groupBy("check_id").agg(F.max_by(F.struct(*[c for c in candidates.columns if c != "check_id"]), "recovery").alias("c")).select("check_id", "c.*")
    rows = last.join(executions, ["recovery", "check_id"], "left").join(targets, ["recovery", "check_id"], "left")
    authority = candidate_authority(F.col("explicit"), F.col("fallback"), F.col("strategy"), F.col("expected_baseline"))
    rows = rows.withColumn("authority", authority).withColumn("trusted", F.col("authority").isin(TRUSTED))
    certified = F.col("trusted") & yes(F.col("stable")) & yes(F.col("status") == "FAIL") & yes(F.col("n_requirements") > 0) & yes(F.col("n_symbols") > 0)
    return rows.select("check_id", "authority", "strategy", yes(F.col("stable")).alias("stable"), F.col("status").alias("baseline_status"), "trusted", certified.alias("certified"))


def locked_comparison(locked: Column, trial: Column, executed: Column) -> Column:
    """struct(before, after, comparable) of three structs with arrays before and after: the locked set's ids, else the
    trial's, else those executed. Empty and null lists count as missing."""
    some = lambda c: F.when(F.size(c) > 0, c)
    pick = lambda side: F.coalesce(some(locked[side]), some(trial[side]), some(executed[side]), F.array().cast("array<string>"))
    before, after = pick("before"), pick("after")
    return F.struct(before.alias("before"), after.alias("after"), ((F.size(before) > 0) & (before == after)).alias("comparable"))


def transition_authority(transitions: DataFrame, compared: DataFrame, catalog: DataFrame) -> DataFrame:
    """transition, authority: MECHANICAL, else the best trusted letter among its targets, else E, else UNTRUSTED.

    transitions: transition, mechanical_checks (count). compared: transition, check_id. catalog: check_id, authority.
    """
    best = compared.join(catalog.select("check_id", "authority"), "check_id").groupBy("transition").agg(F.min(F.when(F.col("authority").isin(TRUSTED), F.col("authority"))).alias("letter"), F.bool_or(F.col("authority") == "E").alias("e"))
    label = F.when(F.col("mechanical_checks") > 0, "MECHANICAL").when(F.col("letter").isNotNull(), F.col("letter")).when(yes(F.col("e")), "E").otherwise("UNTRUSTED")
    return transitions.join(best, "transition", "left").select("transition", label.alias("authority"))


def confirmed_transition(authority: Column, comparable: Column, mechanical_checks: Column, before: Column, after: Column, n_compared: Column, mechanical_pass: Column) -> Column:
    """before, after: arrays of structs (status, stable) of the trial's results."""
    told = lambda runs: (F.size(runs) > 0) & F.forall(runs, lambda r: yes(r["stable"]) & yes(r["status"].isin("PASS", "FAIL")))
    mechanical = yes(mechanical_checks > 0) & yes(told(before)) & yes(told(after))
    return (authority.isin(TRUSTED) | mechanical) & yes(comparable) & (yes(n_compared > 0) | mechanical) & yes(mechanical_pass)


def finalize_best_patch(trajectories: DataFrame) -> DataFrame:
    """trajectory, patch: the best evidence's patch, else the first one."""
    return trajectories.select("trajectory", F.coalesce("best_evidence_patch", "first_patch").alias("patch"))


def exposes_issue(runs: DataFrame) -> DataFrame:
    """candidate, exposes: all runs of its own check fail, stable, with a return code other than 0 and no word of a broken
    environment. runs: candidate, check_id, relation, executable, status, stable, return_code, output."""
    text = F.lower(F.coalesce("output", F.lit("")))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | text.contains(m)
    runs_it = yes(F.col("executable")) & yes(F.col("relation") == "baseline_failure_must_become_pass")
    fails = yes(F.col("check_id") == F.col("candidate")) & yes(F.col("status") == "FAIL") & yes(F.col("stable")) & yes(F.col("return_code") != 0) & ~marked
    return runs.groupBy("candidate").agg(F.every(runs_it & fails).alias("exposes"))


def certify(candidates: DataFrame, runs: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """candidate, certified, reason. Four gates; the reason lists those that miss, in order.

    candidates: candidate, relation, executable, authority, stability_runs. runs: candidate, check_id, status, stable,
    return_code, output. units: unit, check_id, symbol. edges: type, source, target; a target that ran one of its units'
    own symbols reaches the code.
    """
    ran = candidates.select("candidate", "relation", "executable").join(runs, "candidate")
    seen = ran.groupBy("candidate").agg(F.every(yes(F.col("stable"))).alias("all_stable")).join(exposes_issue(ran), "candidate")
    hit = edges.where("type = 'CHECK_EXECUTED_SYMBOL'").select(F.col("source").alias("check_id"), F.col("target").alias("symbol"))
    reaches = units.join(hit, ["check_id", "symbol"], "left_semi").select(F.col("check_id").alias("candidate")).distinct().withColumn("reaches", F.lit(True))
    rows = candidates.join(seen, "candidate", "left").join(reaches, "candidate", "left")
    gates = [
        ("trusted_oracle", yes(F.col("executable")) & yes(F.col("authority").isin(TRUSTED))),
        ("stable_execution", yes(F.col("stability_runs") >= 2) & yes(F.col("all_stable"))),
        ("exposes_issue", yes(F.col("exposes"))),
        ("reaches_related_code", yes(F.col("reaches"))),
    ]
    missing = F.concat_ws(",", *[F.when(~ok, name) for name, ok in gates])
    return rows.select("candidate", (missing == "").alias("certified"), F.when(missing == "", "CERTIFIED").otherwise(F.concat(F.lit("MISSING:"), missing)).alias("reason"))
