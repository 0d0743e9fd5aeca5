"""The edge ledger: each edge that leaves a path, on it or back towards its observations, with a status and its proof.

Which nodes lead to what a path observes is worked out once for each set of observations, and shared by all paths with
that set: one search per set, all in one run, and only over edges between what leaves a path and what is observed. Sets,
paths and edges are numbers until the last join. Nulls in arrays count for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entrypoints import PATH
from .paths import NO_GUARD, contradicts
from .search import between, spread
from .store import Rounds

#: Statuses, proofs and frontiers.
ENUMERATED, PRESERVED, INFEASIBLE, FRONTIER = "ENUMERATED", "PRESERVATION_ONLY", "PROVED_INFEASIBLE", "FRONTIER"
DISCHARGES = ("post-observation-discharge", "structural-edge-discharge", "infeasibility-proof")
FRONTIERS = ("DYNAMIC_TARGET", "UNENUMERATED_FEASIBLE_EDGE")
UNKNOWN_TARGET = "unknown_dynamic_target"


def edge_ledger(paths: DataFrame, edges: DataFrame, nodes: DataFrame, partitions: DataFrame) -> DataFrame:
    """leaf, partition, path, node, edge_id, kind, status, proof, frontier: a row for each node of a path and each edge
    that leaves it, if the edge is on the path or one of its targets leads to one of the path's observations.

    paths: leaf, partition, path, nodes, edges, observations (arrays); edges: edge_id, kind, src, dst, condition (a row for
    each source and target); nodes: node, kind; partitions: partition, constraints (array). An edge on the path is
    ENUMERATED. One that leaves an observation or isn't a path relation is for preservation only. One whose condition
    contradicts the partition's constraints is infeasible. What is left is a frontier: an unknown target, or a feasible
    edge that no path goes along.
    """
    rounds = Rounds(edges.sparkSession, "ledger")
    clean = lambda c: F.coalesce(F.filter(F.col(c), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    number = F.monotonically_increasing_id()  # fixed by the write that follows
    key = ["leaf", "partition", "path"]
    walked = rounds.put(paths.select(*key, clean("nodes").alias("nodes"), clean("edges").alias("edges"), F.array_sort(F.array_distinct(clean("observations"))).alias("seen")).distinct().withColumn("row", number))
    sets = rounds.put(walked.select("seen").distinct().withColumn("search", number))
    at = walked.join(sets, "seen").select("row", "search", "seen", F.explode(F.array_distinct("nodes")).alias("node"))
    at = rounds.put(at.select("row", "search", "node", F.array_contains("seen", F.col("node")).alias("observed")))
    out = edges.where("src is not null and dst is not null").select("edge_id", F.col("kind").alias("relation"), F.col("src").alias("node"), "dst", "condition")
    unknown = nodes.where(F.col("kind") == UNKNOWN_TARGET).select(F.col("node").alias("dst"), F.lit(True).alias("unknown")).distinct()
    own = out.join(at.select("node").distinct(), "node", "left_semi").join(unknown, "dst", "left").groupBy("node", "edge_id", "relation", "condition")
    own = rounds.put(own.agg(F.collect_set("dst").alias("targets"), F.bool_or(F.coalesce("unknown", F.lit(False))).alias("unknown")).withColumn("edge", number))
    targets = own.select("node", "edge", F.explode("targets").alias("dst"))
    live = between(edges.where(F.col("kind").isin(PATH)), targets.select(F.col("dst").alias("node")).distinct(), sets.select(F.explode("seen").alias("node")).distinct(), rounds)
    starts = sets.select("search", F.explode("seen").alias("node"), F.lit(0).alias("distance"))
    back, _ = spread(live, starts, forward=False, rounds=rounds)
    leaves = at.select("search", "node").distinct().join(targets, "node").select("search", "edge", "dst")
    leads = rounds.put(leaves.join(back.select("search", F.col("node").alias("dst")), ["search", "dst"], "left_semi").select("search", "edge").distinct())
    leads = leads.join(own.select("edge", "node"), "edge").join(at, ["search", "node"]).select("row", "edge", "observed", F.lit(False).alias("on"))
    on = walked.select("row", F.explode(F.array_distinct("edges")).alias("edge_id")).join(own.select("edge_id", "edge", "node"), "edge_id").join(at, ["row", "node"]).select("row", "edge", "observed", F.lit(True).alias("on"))
    whole = leads.unionByName(on).groupBy("row", "edge").agg(F.bool_or("observed").alias("observed"), F.bool_or("on").alias("on"))
    whole = whole.join(own.select("edge", "node", "edge_id", "relation", "condition", "unknown"), "edge").join(walked.select("row", *key), "row")
    whole = whole.join(partitions.select("partition", "constraints"), "partition", "left")
    guard = F.when(F.col("condition").isNull() | F.col("condition").isin(NO_GUARD), F.array().cast("array<string>")).otherwise(F.array("condition"))
    clash = F.coalesce(contradicts(F.concat(F.coalesce("constraints", F.array().cast("array<string>")), guard)), F.lit(False))
    told = lambda status, proof=None, frontier=None: F.struct(*[F.lit(v).cast("string").alias(n) for n, v in (("status", status), ("proof", proof), ("frontier", frontier))])
    state = (
        F.when(F.col("on"), told(ENUMERATED))
        .when(F.col("observed"), told(PRESERVED, DISCHARGES[0]))
        .when(~F.col("relation").isin(PATH), told(PRESERVED, DISCHARGES[1]))
        .when(clash, told(INFEASIBLE, DISCHARGES[2]))
        .when(F.col("unknown"), told(FRONTIER, None, FRONTIERS[0]))
        .otherwise(told(FRONTIER, None, FRONTIERS[1]))
    )
    return rounds.put(whole.withColumn("s", state).select(*key, "node", "edge_id", F.col("relation").alias("kind"), "s.status", "s.proof", "s.frontier"))


def select_challenges(cells: DataFrame, most: int) -> DataFrame:
    """challenge, unit, score, seed of the `most` cells to run: first the best cell of each unit, then the best of all that
    are left. cells: challenge, unit, score. Ties go to the least challenge; a null score or id is no cell.

    Best cells are reduced before they are shuffled, and both lists are cut by top-k, so no task sees all cells.
    """
    if most < 1:
        raise ValueError("most must be positive")
    rounds = Rounds(cells.sparkSession, "select")
    known = cells.select("challenge", "unit", "score").where("challenge is not null and unit is not null and score is not null")
    best = known.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "challenge")).alias("x")).select("x.challenge", "unit", (-F.col("x.s")).alias("score"))
    first, n = rounds.counted(best.orderBy(F.desc("score"), "challenge").limit(most))
    seeds = first.withColumn("seed", F.lit(True))
    if n >= most:
        return seeds
    rest = known.join(first.select("challenge", "unit"), ["challenge", "unit"], "left_anti").orderBy(F.desc("score"), "challenge").limit(most - first.count())
    return rounds.put(seeds.unionByName(rest.withColumn("seed", F.lit(False))))
