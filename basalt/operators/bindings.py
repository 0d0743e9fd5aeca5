"""Bindings of requirements to program parts: units and their nodes, rebinding, components, priorities, reports of runs.

Tables are keyed by names given in each docstring; null booleans count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .gates import yes
from .graph import connected_components
from .pairs import met, met_once
from .store import Rounds

#: How urgent a unit's status is, from the first; relations that connect units, the first ones first;
#: labels of hubs, which connect nothing, and the degree from which they are hubs.
URGENCY = ["FAILING", "PRESERVATION_RISK", "COUNTEREXAMPLE_OPEN", "UNBOUND", "UNKNOWN", "ORACLE_UNAVAILABLE", "ENVIRONMENT_BLOCKED", "BOUND_EXECUTABLE", "BOUND_STATIC", "PASSING"]
RELATIONS = ["repair_cut", "preservation", "observation", "state", "dispatch"]
HUBS, HUB_DEGREE = ["log", "logger", "helper", "fixture"], 100
CHANNEL_KINDS = {
    "return": ["return", "assertion", "observation_point"],
    "exception": ["exception", "assertion", "observation_point"],
    "state": ["field", "assertion", "observation_point"],
    "output": ["external_effect", "assertion", "observation_point"],
    "calls": ["call_site", "protocol_operation", "assertion"],
    "effects": ["external_interface", "external_effect", "assertion"],
}


def relevant_units(units: DataFrame, include_passing: bool = False) -> DataFrame:
    """units: graph, unit, status. Adds place: by urgency, then by name, inside a graph."""
    rank = F
    for i, s in enumerate(URGENCY):
        rank = rank.when(F.col("status") == s, i)
    rows = units if include_passing else units.where(~yes(F.col("status") == "PASSING"))
    place = F.row_number().over(Window.partitionBy("graph").orderBy(rank.otherwise(99), "unit"))
    return rows.withColumn("place", place)


def units_of_nodes(unit_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """unit: those that hold one of the nodes. unit_nodes: unit, node; nodes: node."""
    return unit_nodes.join(nodes.select("node").distinct(), "node", "left_semi").select("unit").distinct()


def candidate_units(relations: DataFrame, changed: DataFrame, unit_nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relation, unit): units at the changed nodes of a relation's file and scope; (relation): those without such a unit,
    for which all changed units stand; (unit): these. The last two aren't multiplied out.

    relations: relation, file, scope. changed: node, file, name (qualified). unit_nodes: unit, node.
    """
    rounds = Rounds(relations.sparkSession, "candidates")
    at = rounds.put(changed.join(unit_nodes, "node").select("file", "name", "unit").distinct())
    fits = (F.col("scope") == "<module>") | F.contains(F.col("name"), F.col("scope"))
    named = at.select("file", "name").distinct().join(relations.select("file", "scope").distinct(), "file").where(fits)
    spots = at.join(named, ["file", "name"]).select("unit", "file", "scope")
    direct = met_once(spots, relations.select("relation", "file", "scope"), ["file", "scope"], "unit", "relation").select("relation", "unit")
    hit = relations.join(named.select("file", "scope").distinct(), ["file", "scope"], "left_semi").select("relation").distinct()
    rest = relations.select("relation").join(hit, "relation", "left_anti")
    return direct, rest, at.select("unit").distinct()


def rebind(previous: DataFrame, current: DataFrame, impacted: DataFrame) -> DataFrame:
    """unit, change: invalidated, rebound, added, removed. previous, current: obligation, unit; impacted: obligation."""
    hit = impacted.select("obligation").distinct()
    label = lambda df, name: df.select("unit", F.lit(name).alias("change"))
    return (
        label(previous.join(hit, "obligation", "left_semi"), "invalidated")
        .unionByName(label(current.join(hit, "obligation", "left_semi"), "rebound"))
        .unionByName(label(current.join(previous.select("obligation"), "obligation", "left_anti"), "added"))
        .unionByName(label(previous.join(current.select("obligation"), "obligation", "left_anti"), "removed"))
    )


def references_current(obligations: DataFrame, needs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """obligation, current: does all that it names still stand? obligations: obligation, has_path; needs: obligation, id,
    is_edge; nodes, edges: id."""
    lost = needs.where("not is_edge").join(nodes.select("id"), "id", "left_anti").select("obligation")
    lost = lost.unionByName(needs.where("is_edge").join(edges.select("id"), "id", "left_anti").select("obligation")).distinct().withColumn("lost", F.lit(True))
    return obligations.join(lost, "obligation", "left").select("obligation", (yes(F.col("has_path")) & F.col("lost").isNull()).alias("current"))


def repair_components(unit_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """unit, component: units that share a node, directly or not; hubs connect nothing. Component: its least unit.

    unit_nodes: unit, node, relation (one of RELATIONS); nodes: node, label, degree. Two units meet at a node in the same
    relation. Each node's units form a star around their least one, so a node that all units hold adds one edge a unit.
    """
    hub = (F.col("degree") > HUB_DEGREE) & F.lower("label").isin(HUBS)
    live = unit_nodes.join(nodes.where(~yes(hub)).select("node"), "node", "left_semi").where(F.col("relation").isin(RELATIONS))
    least = live.groupBy("relation", "node").agg(F.min("unit").alias("src"))
    star = live.join(least, ["relation", "node"]).select("src", F.col("unit").alias("dst")).distinct()
    return connected_components(star).withColumnRenamed("node", "unit")


def comparison_status(pairs: DataFrame) -> DataFrame:
    """unit, status of units with stable pairs of pass or fail. pairs: unit, role, class, baseline, patched,
    baseline_stable, patched_stable."""
    told = yes(F.col("baseline_stable")) & yes(F.col("patched_stable")) & F.col("baseline").isin("PASS", "FAIL") & F.col("patched").isin("PASS", "FAIL")
    rows = pairs.where(told)
    worse = (F.col("class") == "PRESERVATION_REGRESSION") & (F.col("baseline") == "PASS") & (F.col("patched") == "FAIL")
    fails = (F.col("class") == "TARGET_STILL_FAILING") & (F.col("baseline") == "FAIL") & (F.col("patched") == "FAIL")
    target = F.col("role") == "TARGET"
    sums = rows.groupBy("unit").agg(F.bool_or(worse).alias("worse"), F.bool_or(fails).alias("fails"), F.count_if(target).alias("targets"), F.count_if(target & (F.col("class") == "TARGET_FIXED")).alias("fixed"), F.every(F.col("class") == "PASS_PRESERVED").alias("kept"))
    passing = ((F.col("targets") > 0) & (F.col("fixed") == F.col("targets"))) | F.col("kept")
    return sums.select("unit", F.when(F.col("worse"), "PRESERVATION_RISK").when(F.col("fails"), "FAILING").when(passing, "PASSING").otherwise("UNKNOWN").alias("status"))


def project_observation(observation_kind: Column, channels: Column) -> Column:
    """Array of the channels that this kind of node shows; null where the node is missing."""
    fits = lambda c: F.coalesce(*[F.when(c == name, observation_kind.isin(k)) for name, k in CHANNEL_KINDS.items()], observation_kind == "observation_point")
    return F.when(observation_kind.isNotNull(), F.filter(channels, fits))


def hunks_for_symbols(symbols: DataFrame, relations: DataFrame, hunks: DataFrame) -> DataFrame:
    """unit, hunk: hunks in the files of a unit's symbols, or of changed relations in their scopes (equal, or a dotted
    tail). symbols: unit, file, name; relations: file, scope; hunks: hunk, file."""
    parts = F.split("name", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    scoped = symbols.select("unit", F.explode(tails).alias("scope")).join(relations.select(F.col("scope"), F.col("file")).distinct(), "scope").select("unit", "file")
    files = symbols.select("unit", "file").unionByName(scoped)
    return met_once(files, hunks.select("hunk", "file"), ["file"], "unit", "hunk")


#: Lists of paths that a unit folds at once.
LISTS = 256


def path_projection(unit_symbols: DataFrame, paths: DataFrame, most: int = 40) -> DataFrame:
    """unit, path, place: the paths that hold one of a unit's symbols, the first `most` by name (the rule's own limit).
    unit_symbols: unit, node; paths: path, node. A node gives its first `most` paths as one list, and a unit
    folds its lists, LISTS at a time: what is shuffled has a row for each symbol of a unit, and pairs are never rows."""
    first = F.row_number().over(Window.partitionBy("node").orderBy("path"))
    near = paths.select("node", "path").distinct().withColumn("n", first).where(F.col("n") <= most).groupBy("node")
    none = F.when(F.bool_or(F.col("path").isNull()), F.array(F.lit(None).cast(paths.schema["path"].dataType))).otherwise(F.array().cast(ArrayType(paths.schema["path"].dataType)))
    near = near.agg(F.concat(F.collect_list("path"), none).alias("paths"))
    lists = unit_symbols.select("unit", "node").distinct().join(near, "node").select("unit", "node", "paths")
    chunk = F.floor(F.row_number().over(Window.partitionBy("unit").orderBy("node")) / LISTS)
    fold = lambda df, *by: df.groupBy(*by).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("paths")))), 1, most).alias("paths"))
    folded = fold(fold(lists.withColumn("chunk", chunk), "unit", "chunk"), "unit")
    return folded.select("unit", F.posexplode("paths").alias("at", "path")).select("unit", "path", (F.col("at") + 1).alias("place"))


def file_costs(nodes: DataFrame, edges: DataFrame, callables: DataFrame) -> DataFrame:
    """file, nodes, edges (that touch one of its nodes), functions. nodes: node, file; edges: edge_id, src, dst;
    callables: node."""
    own = nodes.select("node", "file")
    touch = edges.select("edge_id", F.col("src").alias("node")).unionByName(edges.select("edge_id", F.col("dst").alias("node")))
    touched = touch.join(own, "node").select("file", "edge_id").distinct().groupBy("file").agg(F.count("*").alias("edges"))
    functions = callables.join(own, "node").groupBy("file").agg(F.count("*").alias("functions"))
    rows = own.groupBy("file").agg(F.count("*").alias("nodes")).join(touched, "file", "left").join(functions, "file", "left")
    return rows.na.fill(0, ["edges", "functions"])


def enclosing_frames(frames: DataFrame, nodes: DataFrame, kinds: list[str], reach: int = 256) -> DataFrame:
    """run, node, place: nodes whose lines hold a run's first frame, kinds of observations first, then the shortest.

    frames: run, file, line; nodes: node, kind, file, line, end_line. Nodes are cut into buckets of lines, so a hot file
    isn't compared all with all.
    """
    end = F.coalesce("end_line", "line")
    spans = nodes.where("line is not null").select("node", "kind", "file", F.col("line").alias("lo"), end.alias("hi")).where("lo <= hi")
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor(F.col("hi") / reach))))
    hit = frames.withColumn("bucket", F.floor(F.col("line") / reach)).join(spans, ["file", "bucket"]).where("line between lo and hi")
    order = Window.partitionBy("run").orderBy(~F.col("kind").isin(kinds), F.col("hi") - F.col("lo"), "node")
    return hit.select("run", "node", F.row_number().over(order).alias("place"))


def diagnose(cases: DataFrame, origins: DataFrame, slice_nodes: DataFrame, exits: DataFrame) -> DataFrame:
    """case, mechanism: what most likely broke. origins: case, origin (of outcomes that don't pass); slice_nodes: case,
    kind; exits: case, exit."""
    o = origins.groupBy("case").agg(F.bool_or(F.col("origin") == "PATCH_MECHANICAL").alias("mechanical"), F.bool_or(F.col("origin") == "PRESERVATION").alias("kept"))
    kinds = lambda name, *ks: F.bool_or(F.col("kind").isin(*ks)).alias(name)
    s = slice_nodes.groupBy("case").agg(kinds("protocol", "protocol_operation"), kinds("branch", "branch", "loop"), kinds("state", "field", "state_write", "state_read"))
    x = exits.groupBy("case").agg(F.bool_or(F.col("exit") == "exception").alias("throws"))
    rows = cases.select("case").join(o, "case", "left").join(s, "case", "left").join(x, "case", "left")
    on = lambda c: yes(F.col(c))
    mechanism = (
        F.when(on("mechanical"), "mechanical_repair").when(on("kept"), "preservation_restore").when(on("protocol"), "dispatch_protocol")
        .when(on("branch"), "guard_boundary").when(on("state"), "state_order").when(on("throws"), "exception_contract").otherwise("return_relation")
    )
    return rows.select("case", mechanism.alias("mechanism"))


def mechanism_candidates(kinds: Column) -> Column:
    """What to try in a core whose cuts have these kinds of nodes, in order."""
    has = lambda *ks: F.arrays_overlap(kinds, F.array(*map(F.lit, ks)))
    tries = [F.when(has("branch", "loop"), "guard_boundary"), F.when(has("protocol_operation", "dispatch_slot"), "dispatch_protocol"), F.when(has("exception", "handler"), "exception_contract"), F.when(has("field", "assignment", "state_write"), "state_order"), F.lit("return_relation"), F.lit("mechanism_rewrite")]
    return F.array_compact(F.array(*tries))


def within_budget(nodes: Column, edges: Column, expired: Column, rss: Column, max_nodes: Column, max_edges: Column, max_rss: Column) -> Column:
    """Why a build stops here; null if it goes on. Measurements are columns, so the rule is pure."""
    return F.when(yes(expired), "DEADLINE").when(nodes >= max_nodes, "NODE_LIMIT").when(edges >= max_edges, "EDGE_LIMIT").when(rss >= max_rss, "RSS_LIMIT")


#: Stages of an analysis in order.
STAGE_ORDER = ["semantic_analysis", "repository_index", "requirement_core", "initial_localization", "active_program_slice", "requirement_graph_initial", "binding_graph_initial", "challenge_graph_initial", "first_patch_generation", "initial_revision_validation", "program_graph_incremental", "requirement_graph_incremental", "binding_graph_incremental", "challenge_graph_incremental"]
EXHAUSTED = ["REVISION_BUDGET_EXHAUSTED_WITH_TARGET_FAILURE", "REVISION_BUDGET_EXHAUSTED_WITH_UNCERTIFIED_PATCH"]


def is_failure(stage: Column, status: Column) -> Column:
    return ~(yes(status == "PASS") | (yes(stage == "generation") & yes(status == "REACHED")))


def failure_point(stage: Column, status: Column, phases: Column, in_progress: Column, completed: Column) -> Column:
    """Where a case failed. phases: array in order; in_progress, completed: arrays of stage names."""
    last = F.element_at(F.filter(phases, lambda p: (p != "") & (p != "SEALED")), -1)
    done = F.element_at(F.filter(F.array(*map(F.lit, STAGE_ORDER)), lambda s: F.array_contains(completed, s)), -1)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return (
        F.when(stage == "official_harness", "official_harness")
        .when(status == "SEMANTIC_BLOCKED", "semantic_analysis")
        .when(status == "NO_LEGAL_ACTION", "repair_action_selection")
        .when(some(F.filter(phases, lambda p: (p != "") & (p != "SEALED"))), F.lower(last))
        .when(some(in_progress), F.array_max(in_progress))
        .when(some(F.filter(completed, lambda s: s.isin(STAGE_ORDER))), done)
        .otherwise("generation")
    )


def failure_reason(error: Column, stage: Column, status: Column, target: Column, preservation: Column, counts: Column) -> Column:
    """counts: struct(submitted, deferred, active, real)."""
    n = lambda c: F.coalesce(counts[c], F.lit(0)).cast("string")
    spent = F.concat(F.lit("revision budget exhausted before Reach: submitted="), n("submitted"), F.lit(", deferred_bindings="), n("deferred"), F.lit(", active_challenges="), n("active"), F.lit(", real_challenge_executions="), n("real"))
    harness = F.concat(F.lit("official harness isolated result: target="), F.coalesce(target, F.lit("UNKNOWN")), F.lit(", preservation="), F.coalesce(preservation, F.lit("UNKNOWN")))
    return F.when(F.coalesce(error, F.lit("")) != "", error).when(stage == "official_harness", harness).when(status.isin(EXHAUSTED), spent).otherwise("no certified Reach transition was available")


def lineage_matches(value: Column, expected: Column) -> Column:
    """Maps: does the first hold all of the second's entries? A missing entry is the empty text."""
    return yes(F.forall(F.map_keys(expected), lambda k: F.coalesce(value[k], F.lit("")) == F.coalesce(expected[k], F.lit(""))))


def undominated(assignments: DataFrame, by: str) -> DataFrame:
    """Assignments that no other of the same `by` beats: at least its score, all of its clusters and its explicit claims,
    and more of one of them. assignments: by, assignment, score, clusters (array), explicit. Adds place: by score, number
    of clusters, explicit claims, then name.

    Rows of equal figures are one before they are compared, so a group meets itself only through its distinct figures.
    """
    figures = assignments.select(by, "score", F.array_sort("clusters").alias("clusters"), "explicit").distinct()
    a, b = figures.alias("a"), figures.alias("b")
    covers = F.size(F.array_except("a.clusters", "b.clusters")) == 0
    beats = (F.col("b.score") >= F.col("a.score")) & covers & (F.col("b.explicit") >= F.col("a.explicit"))
    differs = (F.col("b.score") > F.col("a.score")) | (F.col("b.clusters") != F.col("a.clusters")) | (F.col("b.explicit") > F.col("a.explicit"))
    top = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & beats & differs, "left_anti")
    kept = assignments.withColumn("clusters", F.array_sort("clusters")).join(top, [by, "score", "clusters", "explicit"], "left_semi")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc(F.size("clusters")), F.desc("explicit"), "assignment"))
    return kept.withColumn("place", place)


def assignment_scores(choices: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """assignment, score: 5, 3 or 2 for a claim of authority A, B or C, a half for any other, -1 for an unknown, and a
    quarter for each independent cluster of evidence. choices: assignment, claim (null: unknown); claims: claim,
    authority; evidence: claim, cluster."""
    worth = F.when(F.col("claim").isNull(), -1.0).when(F.col("authority") == "A", 5.0).when(F.col("authority") == "B", 3.0).when(F.col("authority") == "C", 2.0).otherwise(0.5)
    base = choices.join(claims, "claim", "left").groupBy("assignment").agg(F.sum(worth).alias("base"))
    own = choices.join(evidence, "claim").groupBy("assignment").agg(F.countDistinct("cluster").alias("clusters"))
    return base.join(own, "assignment", "left").select("assignment", (F.col("base") + F.coalesce("clusters", F.lit(0)) * 0.25).alias("score"))


def unit_statuses(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """unit, statuses (sorted, each once; empty for a unit without outcomes), also for outcomes of unknown units."""
    seen = outcomes.groupBy("unit").agg(F.array_sort(F.collect_set("status")).alias("statuses"))
    rows = units.select("unit").distinct().join(seen, "unit", "full")
    return rows.select("unit", F.coalesce("statuses", F.array().cast("array<string>")).alias("statuses"))


def protocol_projection(unit_symbols: DataFrame, operations: DataFrame, candidates: DataFrame, most: int = 40) -> DataFrame:
    """unit, operation, place: operations at one of a unit's symbols, or that may call one; the first `most` by name (the
    rule's own limit). unit_symbols: unit, node; operations: operation, source; candidates: operation, target."""
    at = operations.select("operation", F.col("source").alias("node")).unionByName(candidates.select("operation", F.col("target").alias("node")))
    hit = unit_symbols.join(at, "node").select("unit", "operation").distinct()
    place = F.row_number().over(Window.partitionBy("unit").orderBy("operation"))
    return hit.withColumn("place", place).where(F.col("place") <= most)


def check_projection(requirements: DataFrame, checks: DataFrame) -> DataFrame:
    """requirement, check_id, role: checks that bind a requirement, by name, by shared evidence, by their oracle, or by an
    executed symbol that one of the requirement's overlaps.

    requirements: requirement, evidence array, symbols array; checks: check_id, role, requirements array, evidence array,
    oracle, symbols array. Each way is an equi-join: symbols overlap if one is a dotted tail of the other, or if both are
    dotted and end alike, so tails and last parts are joined. Checks of equal evidence and symbols are one class for it;
    classes' pairs are made unique, and the checks' own pairs laid out last, with what is bound by name alone.
    """
    rounds = Rounds(checks.sparkSession, "projection")
    merged = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda x: x.isNotNull()))).alias(c)
    signed = rounds.put(checks.where("check_id is not null").groupBy("check_id").agg(merged("evidence"), merged("symbols")))
    alike = rounds.put(signed.groupBy("evidence", "symbols").agg(F.min("check_id").alias("like")))
    member = rounds.put(signed.join(alike, ["evidence", "symbols"]).select("check_id", "like"))
    by_name = checks.select("check_id", F.explode("requirements").alias("requirement"))
    by_oracle = checks.select("check_id", F.col("oracle").alias("requirement"))
    named = by_name.unionByName(by_oracle).join(requirements.select("requirement").distinct(), "requirement", "left_semi").select("requirement", "check_id").distinct()
    shared = requirements.select("requirement", F.explode("evidence").alias("e")).join(alike.select("like", F.explode("evidence").alias("e")), "e").select("requirement", "like")
    parts = lambda c: F.split(c, "\\.")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.array_join(F.slice(parts(c), i, F.size(parts(c))), "."))
    own = requirements.select("requirement", F.explode("symbols").alias("s")).where("s <> ''")
    ran = alike.select("like", F.explode("symbols").alias("x")).where("x <> ''")
    one = own.select("requirement", F.explode(tails("s")).alias("x")).join(ran, "x").select("requirement", "like")
    two = ran.select("like", F.explode(tails("x")).alias("s")).join(own, "s").select("requirement", "like")
    last = lambda df, c: df.where(F.contains(c, F.lit("."))).withColumn("tail", F.substring_index(c, ".", -1)).drop(c).distinct()
    alias = last(own, "s").join(last(ran, "x"), "tail").select("requirement", "like")
    classes = rounds.put(shared.unionByName(one).unionByName(two).unionByName(alias).distinct())
    role = F.when(F.col("role").isin("TARGET", "PRESERVATION"), F.col("role")).otherwise("CHALLENGE")
    told = checks.select("check_id", role.alias("role"))
    only = named.join(member, "check_id").join(classes, ["requirement", "like"], "left_anti").select("requirement", "check_id").join(told, "check_id")
    return met(classes, member.join(told, "check_id"), ["like"], rounds).unionByName(only.select("requirement", "check_id", "role"))


def add_nodes(nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the new ones, collisions: node): a node whose id stands for another is refused; the same again changes
    nothing."""
    columns = [c for c in nodes.columns if c != "node"]
    was = nodes.select("node", F.struct(*columns).alias("was"))
    first = new.groupBy("node").agg(F.min(F.struct(*columns)).alias("now"), F.max(F.struct(*columns)).alias("last"))
    rows = first.join(was, "node", "left").withColumn("clash", (F.col("now") != F.col("last")) | ~F.coalesce("was", "now").eqNullSafe(F.col("now")))
    fresh = rows.where("not clash and was is null").select("node", "now.*")
    return nodes.unionByName(fresh), rows.where("clash").select("node")


def registered_relations(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of a registered kind, or of one that starts with `custom:`."""
    return edges.where(F.col("kind").isin(kinds) | F.startswith("kind", F.lit("custom:")))


def target_sets(edges: DataFrame) -> DataFrame:
    """targets (sorted, each once), n: each exact set of targets once, with the number of edges that share it."""
    return edges.groupBy(F.array_sort(F.array_distinct("targets")).alias("targets")).agg(F.count("*").alias("n"))


def run_report(runs: DataFrame, outcomes: DataFrame, frontiers: DataFrame, transitions: DataFrame) -> DataFrame:
    """A row per run: passes, fails, unknowns, open hard frontiers, commits and rollbacks. runs: run; outcomes: run,
    status; frontiers: run, hard, status; transitions: run, decision."""
    s, d = F.col("status"), F.col("decision")
    o = outcomes.groupBy("run").agg(F.count_if(s == "PASS").alias("passed"), F.count_if(s == "FAIL").alias("failed"), F.count_if(~s.isin("PASS", "FAIL")).alias("unknown"))
    f = frontiers.groupBy("run").agg(F.count_if(yes(F.col("hard")) & (s == "OPEN")).alias("hard_open"), F.count_if(s == "OPEN").alias("open"))
    t = transitions.groupBy("run").agg(F.count_if(d == "COMMIT").alias("commits"), F.count_if(d == "ROLLBACK").alias("rollbacks"))
    rows = runs.select("run").join(o, "run", "left").join(f, "run", "left").join(t, "run", "left")
    return rows.na.fill(0, [c for c in rows.columns if c != "run"])


def obligation_keys(obligations: DataFrame) -> DataFrame:
    """leaf, constraints, entry, guards, exit, observation, obligations: obligations that mean the same path, by what the
    path does and not by its name."""
    key = [F.col("leaf"), F.array_sort("constraints").alias("constraints"), F.col("entry"), F.col("guards"), F.col("exit"), F.col("observation")]
    return obligations.groupBy(*key).agg(F.min("obligation").alias("first"), F.count("*").alias("n"))
