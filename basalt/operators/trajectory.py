"""Reports of revision trajectories: which revisions a run made, which of them count, and which patch is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import yes


def promoted(confirmed: Column, target_delta: Column, regression_delta: Column, mechanical_delta: Column, mechanical_failures: Column) -> Column:
    n = lambda c: F.coalesce(c, F.lit(0))
    gain = (n(target_delta) > 0) | (n(regression_delta) < 0) | (n(mechanical_delta) > 0)
    return yes(confirmed) & gain & (n(mechanical_failures) == 0)


def revisions(patches: DataFrame, transitions: DataFrame) -> DataFrame:
    """run, seq, transition, before_hash, after_hash, decision, promoted: the revisions of each run, in order.

    patches: run, seq, hash, has_diff. transitions: run, seq, transition, before_hash, after_hash, cumulative_hash,
    confirmed, target_delta, regression_delta, mechanical_delta, mechanical_failures. The transition that first makes a
    run's first patch is no revision. Runs without a non-empty patch have none.
    """
    first = patches.where(yes(F.col("has_diff"))).groupBy("run").agg(F.min_by("hash", "seq").alias("first_hash"))
    after = F.coalesce(F.nullif("after_hash", F.lit("")), F.nullif("cumulative_hash", F.lit("")), F.lit(""))
    rows = transitions.join(first, "run").withColumn("after", after).withColumn("before", F.coalesce("before_hash", F.lit("")))
    makes = (F.col("after") == F.col("first_hash")) & (F.col("before") != F.col("first_hash"))
    creation = rows.where(makes).groupBy("run").agg(F.min("seq").alias("created"))
    kept = rows.join(creation, "run", "left").where("created is null or seq <> created")
    up = promoted(*[F.col(c) for c in ("confirmed", "target_delta", "regression_delta", "mechanical_delta", "mechanical_failures")])
    decision = F.when(yes(F.col("confirmed")), "ELIGIBLE_FOR_POLICY_EVALUATION").otherwise("REJECT_NO_CONFIRMED_COMPARABLE_EXECUTION")
    return kept.select("run", "seq", "transition", F.col("before").alias("before_hash"), F.col("after").alias("after_hash"), decision.alias("decision"), up.alias("promoted"))


def report(runs: DataFrame, patches: DataFrame, transitions: DataFrame) -> DataFrame:
    """A row per run: status, first and selected patch, counts, and whether the first patch was changed later."""
    real = patches.where(yes(F.col("has_diff")))
    first = real.groupBy("run").agg(F.min_by("hash", "seq").alias("first_patch"), F.countDistinct("hash").alias("patches"))
    rev = revisions(patches, transitions).join(first.select("run", "first_patch"), "run")
    changed = (F.col("before_hash") == F.col("first_patch")) & (F.col("after_hash") != F.col("first_patch"))
    sums = rev.groupBy("run").agg(
        F.count("*").alias("revisions"),
        F.count_if("promoted").alias("promoted"),
        F.max_by(F.nullif("after_hash", F.lit("")), F.when(F.col("promoted"), F.col("seq"))).alias("last"),
        F.bool_or(changed).alias("modified"),
    )
    rows = runs.select("run").join(first, "run", "left").join(sums, "run", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    selected = F.coalesce(F.when(F.col("promoted") > 0, F.col("last")), "first_patch", F.lit(""))
    status = F.when(F.col("first_patch").isNull(), "NO_NONEMPTY_CHECKPOINT").otherwise("REPLAYED")
    return rows.select("run", status.alias("status"), F.coalesce("first_patch", F.lit("")).alias("first_patch"), selected.alias("selected_patch"), n("patches"), n("revisions"), n("promoted"), yes(F.col("modified")).alias("modified"), (F.col("first_patch").isNotNull() & (selected == F.col("first_patch"))).alias("used_first"))


