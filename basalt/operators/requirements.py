"""Requirement tables: leaves and their authority, path obligations, closure, coverage rows, and the join to paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import yes

#: Fixed values.
AUTHORITY_CLASSES = ["HARD", "DERIVED", "HYPOTHESIS", "PRESERVATION"]
LEDGER_DONE = ["ENUMERATED", "PROVED_INFEASIBLE", "PRESERVATION_ONLY"]
PROOFS = ["finite_domain_exhausted", "unsupported_constraint", "missing_domain"]
TRUSTED_AUTHORITIES = ["A", "B", "C"]


def feasible_obligations(obligations: DataFrame) -> DataFrame:
    return obligations.where(yes(F.col("feasible")))


def mandatory_leaves(leaves: DataFrame) -> DataFrame:
    return leaves.where(yes(F.col("mandatory")))


def partition_leaves(leaves: DataFrame) -> DataFrame:
    """graph, part, leaves (sorted): a part per authority class, and PROVISIONAL for those without a trusted authority.
    leaves: graph, leaf, authority, authority_class. Parts without leaves have no row."""
    classes = leaves.select("graph", "leaf", F.col("authority_class").alias("part"))
    loose = leaves.where(~yes(F.col("authority").isin(TRUSTED_AUTHORITIES))).select("graph", "leaf", F.lit("PROVISIONAL").alias("part"))
    return classes.where(F.col("part").isin(AUTHORITY_CLASSES)).unionByName(loose).groupBy("graph", "part").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))


def apply_authority(leaves: DataFrame, changes: DataFrame, obligations: DataFrame) -> DataFrame:
    """leaf, authority, authority_class, mandatory, coverage_status, invalidated (sorted obligations) of changed leaves.
    changes: leaf, authority, authority_class; obligations: obligation, leaf. Unknown leaves are left out."""
    dead = obligations.groupBy("leaf").agg(F.array_sort(F.collect_list("obligation")).alias("invalidated"))
    rows = changes.join(leaves.select("leaf").distinct(), "leaf", "left_semi").join(dead, "leaf", "left")
    must = yes(F.col("authority").isin(TRUSTED_AUTHORITIES) & F.col("authority_class").isin(AUTHORITY_CLASSES))
    none = F.array().cast(dead.schema["invalidated"].dataType)
    return rows.select("leaf", "authority", "authority_class", must.alias("mandatory"), F.lit("AUTHORITY_CHANGED_RECOMPILE_REQUIRED").alias("coverage_status"), F.coalesce("invalidated", none).alias("invalidated"))


def is_proven_unsat(satisfiable: Column, complete: Column, reason: Column) -> Column:
    """Only a closed-world proof counts; a reason with a suffix is none."""
    return ~yes(satisfiable) & yes(complete) & yes(reason.isin(PROOFS))


def path_closure(leaves: DataFrame, obligations: DataFrame, ledger: DataFrame, frontiers: DataFrame) -> DataFrame:
    """A row per graph: closed, coverage, missing leaves, nonterminal ledger rows, open hard frontiers.

    leaves: graph, leaf, weight, mandatory. obligations: graph, obligation, leaf, feasible. ledger: graph, ledger, status.
    frontiers: graph, frontier, owner, hard, status. A leaf's weight counts once per feasible obligation; an open
    frontier adds its owning leaf's weight, or 1.
    """
    feasible = feasible_obligations(obligations)
    graphs = leaves.select("graph").distinct()
    weight = leaves.select("graph", "leaf", "weight")
    done = feasible.join(weight, ["graph", "leaf"]).groupBy("graph").agg(F.sum("weight").alias("numerator"))
    open_ = frontiers.where("status = 'OPEN'")
    owed = open_.join(weight.withColumnRenamed("leaf", "owner"), ["graph", "owner"], "left").groupBy("graph").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("owed"))
    ids = lambda df, c, name: df.groupBy("graph").agg(F.array_sort(F.collect_list(c)).alias(name))
    missing = ids(mandatory_leaves(leaves).join(feasible.select("graph", "leaf").distinct(), ["graph", "leaf"], "left_anti"), "leaf", "missing")
    rest = ids(ledger.where(~yes(F.col("status").isin(LEDGER_DONE))), "ledger", "nonterminal")
    hard = ids(open_.where("hard"), "frontier", "frontiers")
    any_path = obligations.groupBy("graph").agg(F.lit(True).alias("any_path"))
    rows = graphs
    for t in (done, owed, missing, rest, hard, any_path):
        rows = rows.join(t, "graph", "left")
    n, d = F.coalesce("numerator", F.lit(0.0)), F.coalesce("numerator", F.lit(0.0)) + F.coalesce("owed", F.lit(0.0))
    closed = yes(F.col("any_path")) & F.col("missing").isNull() & F.col("nonterminal").isNull() & F.col("frontiers").isNull()
    none = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("graph", closed.alias("closed"), F.when(d > 0, n / d).otherwise(0.0).alias("coverage"), none("missing"), none("nonterminal"), none("frontiers"))


def binding_closure(leaves: DataFrame, obligations: DataFrame, units: DataFrame, frontiers: DataFrame, graphs: DataFrame) -> DataFrame:
    """A row per graph: closed, ready ratio, and missing, duplicate, stale, blocked and frontier ids.

    units: graph, unit, obligation, leaf, status, requirement_hash, program_hash; graphs: graph, requirement_hash,
    program_hash (the current ones).
    """
    feasible = feasible_obligations(obligations)
    bound = units.groupBy("graph", "obligation").agg(F.count("*").alias("n"))
    known = feasible.select("graph", "obligation", "leaf").join(bound, ["graph", "obligation"], "left")
    weight = leaves.select("graph", "leaf", "weight")
    ids = lambda df, c, name: df.groupBy("graph").agg(F.array_sort(F.collect_list(c)).alias(name))
    now = graphs.select("graph", F.col("requirement_hash").alias("rh"), F.col("program_hash").alias("ph"))
    stale = units.join(now, "graph").where("requirement_hash <> rh or program_hash <> ph")
    open_ = ids(frontiers.where("hard and status = 'OPEN'"), "frontier", "frontiers")
    ready = units.where("status = 'READY'").join(weight, ["graph", "leaf"]).groupBy("graph").agg(F.sum("weight").alias("ready"))
    total = feasible.join(weight, ["graph", "leaf"]).groupBy("graph").agg(F.sum("weight").alias("total"))
    any_path = feasible.groupBy("graph").agg(F.lit(True).alias("any_path"))
    rows = graphs.select("graph")
    for t in (ids(known.where("n is null"), "obligation", "missing"), ids(known.where("n > 1"), "obligation", "duplicates"), ids(stale, "unit", "stale"), ids(units.where("status <> 'READY'"), "unit", "blocked"), open_, ready, total, any_path):
        rows = rows.join(t, "graph", "left")
    lists = ["missing", "duplicates", "stale", "blocked", "frontiers"]
    d = F.coalesce("total", F.lit(0.0)) + F.coalesce(F.size("frontiers"), F.lit(0))
    closed = F.lit(True)
    for c in lists:
        closed = closed & F.col(c).isNull()
    ratio = F.when(d > 0, F.coalesce("ready", F.lit(0.0)) / d).when(F.col("any_path").isNull(), 1.0).otherwise(0.0)
    none = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("graph", closed.alias("closed"), ratio.alias("ready_ratio"), *[none(c) for c in lists])


def unresolved_rows(coverage: DataFrame) -> DataFrame:
    return coverage.where(~yes(F.col("status") == "PASSING"))


def requirement_paths(leaves: DataFrame, paths: DataFrame, partitions: DataFrame, most: int) -> DataFrame:
    """leaf, path, partition, n_edges, place: the shortest path of each (guard, exit, observations) of a leaf.

    leaves: leaf, channels. paths: leaf, path, feasible, exit, guard, names, observations, n_edges. partitions: leaf,
    partition, satisfiable, names, constraints. A partition is linked with a path that shares a variable name; with
    none that does, one partition stands for all (True first, then fewest constraints, then the least id); with no
    partition, a path gives nothing. Of equal lengths the first by (path, partition) stays; `most` rows a leaf.
    Names are arrays and are joined by exploding them, so a leaf's paths and partitions are not multiplied.
    """
    usable = paths.where(yes(F.col("feasible")) & (F.size("observations") > 0)).join(leaves, "leaf")
    raises = F.col("exit").isin("exception", "raise")
    fits = F.when(F.array_contains("channels", "exception"), raises).when(F.col("channels") == F.array(F.lit("return")), ~raises).otherwise(True)
    usable = usable.where(fits)
    good = partitions.where(yes(F.col("satisfiable")))
    named = usable.select("leaf", "path", F.explode("names").alias("name")).distinct()
    own = good.select("leaf", "partition", F.explode("names").alias("name")).distinct()
    linked = named.join(own, ["leaf", "name"]).select("leaf", "path", "partition").distinct()
    not_true = (F.col("constraints") != F.array(F.lit("True"))).cast("int")
    one = good.groupBy("leaf").agg(F.min_by("partition", F.struct(not_true, F.size("constraints"), "partition")).alias("partition"))
    alone = usable.select("leaf", "path").join(linked, ["leaf", "path"], "left_anti").join(one, "leaf")
    rows = linked.unionByName(alone.select("leaf", "path", "partition")).join(usable.select("leaf", "path", "guard", "exit", "observations", "n_edges"), ["leaf", "path"])
    first = rows.groupBy("leaf", "guard", "exit", "observations").agg(F.min(F.struct("n_edges", "path", "partition")).alias("x")).select("leaf", "x.*")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("leaf").orderBy("n_edges", "path"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("leaf", "path", "partition", F.col("n_edges").cast("long").alias("n_edges"), "place")


def executable_bindings(requirements: DataFrame, slices: DataFrame, unresolved: DataFrame) -> DataFrame:
    """requirement, kind, check_id, slice, cuts, cut_status: real checks bound to their causal slices, and deferred rows
    for requirements without a check. requirements: requirement, check_id, execution, status; slices: execution, slice,
    cuts (the first twenty are taken: the reference's own limit); unresolved: requirement."""
    target = F.col("status") == "BASELINE_FAILING_TARGET"
    rows = requirements.join(slices, "execution", "left")
    cuts = F.coalesce(F.slice("cuts", 1, 20), F.array().cast(slices.schema["cuts"].dataType))
    state = F.when(F.size(cuts) > 0, "CUT_RESOLVED").when(target, "CUT_UNRESOLVED").otherwise("NOT_REQUIRED")
    bound = rows.select("requirement", F.when(target, "EXECUTABLE_TARGET").otherwise("EXECUTABLE_PRESERVATION").alias("kind"), "check_id", "slice", cuts.alias("cuts"), state.alias("cut_status"))
    types = bound.schema
    late = unresolved.select("requirement", F.lit("DEFERRED_NORMATIVE").alias("kind"), F.lit(None).cast(types["check_id"].dataType).alias("check_id"), F.lit(None).cast(types["slice"].dataType).alias("slice"), F.array().cast(types["cuts"].dataType).alias("cuts"), F.lit("NOT_EVALUABLE").alias("cut_status"))
    return bound.unionByName(late)


#: Which node kinds a channel is seen at.
PROJECTED = ("trigger", "domain_guard", "observation", "oracle")


def bind_compatibility(trigger: Column, domain: Column, observation: Column, oracle: Column) -> Column:
    """struct(compatible, reason): all four projections, or those that fail, in order."""
    parts = [F.when(~yes(c), F.lit(name)) for name, c in zip(PROJECTED, (trigger, domain, observation, oracle), strict=True)]
    lacks = F.concat_ws(";", *parts)
    return F.struct((lacks == "").alias("compatible"), F.when(lacks == "", "compatible").otherwise(lacks).alias("reason"))


def oracle_applicable(active: Column, matching: Column, expected: Column) -> Column:
    """struct(compatible, channels): active and trusted, with a channel in common."""
    both = F.array_sort(F.array_intersect(matching, expected))
    return F.struct((yes(active) & (F.size(both) > 0)).alias("compatible"), both.alias("channels"))


def is_modifiable(kind: Column, file: Column, in_tests: Column, kinds: list[str], forbidden: list[str]) -> Column:
    """May a repair change this node? forbidden: patterns of files, as regular expressions."""
    parts = F.split(file, "/")
    outside = F.startswith(file, F.lit("<")) | F.arrays_overlap(parts, F.array(*map(F.lit, ("tests", "test", "generated", "vendor"))))
    out = kind.isin(kinds) & ~yes(in_tests) & ~kind.isin("test", "assertion", "fixture") & ~outside
    for pattern in forbidden:
        out = out & ~file.rlike(pattern)
    return yes(out)


def is_excluded(path: Column) -> Column:
    """Test, vendored, generated and migration files. The file name's own case counts for its prefix and suffix."""
    parts, name = F.split(F.lower(path), "/"), F.substring_index(path, "/", -1)
    return F.arrays_overlap(parts, F.array(*map(F.lit, ("tests", "test", "vendor", "vendored", "generated", "migrations")))) | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | F.contains(F.lower(name), F.lit(".generated."))
