"""Entrypoints: what a caller controls and from which a changed node (seed) leads on to something observed.

Backwards from all seeds at once goes a search over states (seed, node, set of path conditions): two ways to a node under
different conditions are two states, one whose conditions hold a guard and its negation is infeasible and ends. Runs of
nodes with one way in and one way out are laid together first, in states as in shortest ways, so a run of n nodes takes log
n rounds. A state ends, too,
at a confirmed entrypoint: a controllable node that leads to the seed along path relations, while the seed leads to an
observation. Each state there makes a path to each such observation: a shortest way to the seed, then a shortest one on.

Of equally short ways the one is taken whose step at each node has the least (edge_id, pos); ways are laid out by
doubling steps. Conditions of a path are a set, in text order. An observation that the entrypoint reaches without the
seed has a bypass: one search for each observation, back from it, tells all distances, and without a seed only those
nodes are looked at again whose shortest ways all lead through it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reachable
from .paths import NO_GUARD, STATES, contradicts, corridors
from .search import shortest
from .store import Rounds

#: Relations that a search goes back along, and those that paths are made of.
BACKWARD = ["calls", "may_call", "parameter_flow", "return_flow", "data_flow", "def_use", "control_flow", "control_dependency", "state_read", "state_write", "exception_flow", "raises", "catches", "exports", "alias", "registers", "dispatch", "configures", "triggers", "protocol_selected", "protocol_candidate"]
PATH = ["control_flow", "calls", "may_call", "parameter_flow", "return_flow", "exception_flow", "raises", "catches", "dispatch", "protocol_selected", "protocol_candidate", "state_read", "state_write", "field_flow", "data_flow", "def_use", "triggers", "observes"]
FIELDS = ("edge_id", "pos", "condition", "src")


class Entrypoints(NamedTuple):
    """paths: seed, entry, observation, conditions (array), path_condition, edges (array of edge_id, from the entry on),
    n_edges, confidence, evidence (array), bypass (edges of the shortest way without the seed, else null).
    frontiers: seed, kind. infeasible: node."""

    paths: DataFrame
    frontiers: DataFrame
    infeasible: DataFrame


def shortest_trees(ways: DataFrame, reach: DataFrame, forward: bool, rounds: Rounds) -> DataFrame:
    """search, node, to, steps (edge ids from src to dst): the next way of each visited node towards its search's start."""
    near, far = ("dst", "src") if forward else ("src", "dst")
    here = reach.select("search", F.col("node").alias(near), F.col("distance").alias("d"))
    there = reach.select("search", F.col("node").alias(far), F.col("distance").alias("before"))
    # a visited node meets the ways that its search went on by: those that lead to a node may be far more
    steps = ways.join(there, far).join(here, ["search", near]).where("d = before + length")
    least = F.struct(F.element_at("steps", -1 if forward else 1).alias("step"), F.col(far).alias("to"), "steps")
    return rounds.put(steps.groupBy("search", F.col(near).alias("node")).agg(F.min(least).alias("x")).select("search", "node", "x.to", F.transform("x.steps", lambda s: s["edge_id"]).alias("steps")))


def laid_out(trees: DataFrame, wanted: DataFrame, rounds: Rounds) -> DataFrame:
    """search, goal, ways (array of place, steps; place 0 at the goal): from each wanted node (search, goal) to its search's
    start, in as many rounds as the longest has bits."""
    found = rounds.put(wanted.select("search", "goal", F.lit(0).cast("long").alias("place"), F.col("goal").alias("node")))
    leap, length = trees.select("search", "node", "to"), 1
    while True:
        new, n = rounds.counted(found.join(leap, ["search", "node"]).select("search", "goal", (F.col("place") + length).alias("place"), F.col("to").alias("node")))
        if not n:
            break
        found = found.unionByName(new)
        after = leap.select("search", F.col("node").alias("to"), F.col("to").alias("then"))
        leap = rounds.put(leap.join(after, ["search", "to"]).select("search", "node", F.col("then").alias("to")))
        length *= 2
    taken = found.join(trees.select("search", "node", "steps"), ["search", "node"])
    ways = taken.groupBy("search", "goal").agg(F.array_sort(F.collect_list(F.struct("place", "steps"))).alias("ways"))
    return rounds.put(wanted.select("search", "goal").join(ways, ["search", "goal"], "left").withColumn("ways", F.coalesce("ways", F.array().cast(ways.schema["ways"].dataType))))


def bypasses(ways: DataFrame, around: DataFrame, wanted: DataFrame, rounds: Rounds, stored: bool = False) -> DataFrame:
    """seed, entry, observation (as in wanted), bypass: the length of a shortest way from entry to observation that doesn't
    visit the seed; no row where there is none. around: seed, observation, each seed leading to the other node. stored: as
    in `shortest`.

    Without a seed, a node is lost to an observation if all its shortest ways there go on by lost nodes; it then takes the
    best of its ways to nodes that aren't lost, and lost nodes hand on what they find until nothing gets shorter.
    """
    part, pair = rounds.part("bypass"), ["seed", "observation"]
    if not stored:
        ways = part.put(ways.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("length").alias("length")))
    goals = around.select(F.col("observation").alias("search")).distinct()
    far = shortest(ways, goals.select("search", F.col("search").alias("node"), F.lit(0).alias("distance")), False, rounds=part, stored=True)
    far = far.withColumnRenamed("search", "observation")
    led = far.select("observation", F.col("node").alias("dst"), "distance").join(ways, "dst").select("observation", "src", "dst", "length", (F.col("distance") + F.col("length")).alias("via"))
    # the least `via` of a node is its distance, but for the observation itself; held: by how many ways it has that
    at = Window.partitionBy("observation", "src")
    led = led.withColumn("tight", (F.col("via") == F.min("via").over(at)) & (F.col("src") != F.col("observation")))
    led = part.put(led.withColumn("held", F.when(F.col("tight"), F.count_if("tight").over(at))).drop("tight"))
    tight = led.where("held is not null").select("observation", "src", "dst", "held")
    new, n = part.counted(around.select(*pair, F.col("seed").alias("node")))
    lost, log = new, None
    while n:
        hit, n = part.counted(new.withColumnRenamed("node", "dst").join(tight, ["observation", "dst"]).groupBy(*pair, F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("held").alias("held")))
        if n:
            log = hit if log is None else log.unionByName(hit)
            sums = log.groupBy(*pair, "node").agg(F.sum("n").alias("n"), F.max("held").alias("held")).where("n = held")
            new, n = part.counted(sums.join(hit.select(*pair, "node"), [*pair, "node"], "left_semi").select(*pair, "node"))
            lost = lost.unionByName(new)
    open_ = part.put(lost.where("node <> seed"))
    out = open_.withColumnRenamed("node", "src").join(led, ["observation", "src"]).select(*pair, F.col("src").alias("node"), "dst", "via")
    first = out.join(lost.withColumnRenamed("node", "dst"), [*pair, "dst"], "left_anti").groupBy(*pair, "node").agg(F.min("via").alias("distance"))
    better, n = part.counted(first)
    found = better
    while n:
        step = better.withColumnRenamed("node", "dst").join(led, ["observation", "dst"]).groupBy(*pair, F.col("src").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("distance"))
        step = step.join(open_, [*pair, "node"], "left_semi")
        was = found.groupBy(*pair, "node").agg(F.min("distance").alias("was"))
        better, n = part.counted(step.join(was, [*pair, "node"], "left").where("was is null or distance < was").drop("was"))
        found = found.unionByName(better)
    anew = found.groupBy(*pair, F.col("node").alias("entry")).agg(F.min("distance").alias("anew"))
    key = ["seed", "entry", "observation"]
    asked = wanted.select(*key).distinct().join(around, pair, "left_semi").join(far.select("observation", F.col("node").alias("entry"), "distance"), ["observation", "entry"])
    asked = asked.join(lost.select(*pair, F.col("node").alias("entry"), F.lit(True).alias("lost")), key, "left").join(anew, key, "left")
    told = rounds.put(asked.select(*key, F.when(F.col("lost"), F.col("anew")).otherwise(F.col("distance")).alias("bypass")).where("bypass is not null"))
    part.clear()
    return told


def _leading(edges: DataFrame, goals: DataFrame, rounds: Rounds) -> DataFrame:
    """The edges that lead to a goal (column node), stored: others are on no way back from it."""
    part = rounds.part("leading")
    every = part.put(edges.where("src is not null and dst is not null"))
    leads = reachable(every, goals, forward=False, stored=True)
    out = rounds.put(every.join(leads.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns))
    part.clear()
    return out


def _guards(steps: Column) -> Column:
    return F.filter(F.transform(steps, lambda s: s["condition"]), lambda c: c.isNotNull() & ~c.isin(NO_GUARD))


def _states(edges: DataFrame, seeds: DataFrame, confirmed: DataFrame, keep: DataFrame, states: int, rounds: Rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ends: seed, node, conditions at confirmed entrypoints; capped: seed; infeasible: node)."""
    whole, rounds = rounds, rounds.part("states")
    ways = rounds.put(corridors(edges, keep, rounds, FIELDS))
    text = F.array().cast("array<string>")
    stops = confirmed.withColumn("stops", F.lit(True))
    front, count = rounds.counted(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("conditions", text).withColumn("n", F.lit(1).cast("long")))
    seen, ends, capped = front.select("seed", "node", "conditions"), front.limit(0).select("seed", "node", "conditions"), front.select("seed").limit(0)
    bad, total = front.select("node").limit(0), None
    while count:
        now = front.select("seed", "n")
        total = now if total is None else total.unionByName(now)
        capped = total.groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") > states).select("seed")
        here = front.join(stops, ["seed", "node"], "left").join(capped, "seed", "left_anti")
        ends = ends.unionByName(here.where("stops").select("seed", "node", "conditions"))
        walk = here.where("stops is null").select("seed", F.col("node").alias("at"), "conditions").join(ways, F.col("at") == F.col("dst"))
        more = F.array_sort(F.array_union("conditions", _guards(F.col("steps"))))
        moved = walk.select("seed", F.col("src").alias("node"), "steps", F.col("conditions").alias("was"), more.alias("conditions"))
        moved = moved.withColumn("fails", F.coalesce(contradicts(F.col("conditions")), F.lit(False)))
        moved = rounds.put(moved)
        # where it fails: the last place of the run (nearest to the seed) from which on the conditions contradict
        upto = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.struct((-k).alias("k"), F.element_at("steps", k)["src"].alias("node"), contradicts(F.array_union("was", _guards(F.slice("steps", k, F.size("steps"))))).alias("no")))
        bad = bad.unionByName(moved.where("fails").select(F.array_min(F.filter(upto, lambda x: x["no"]))["node"].alias("node")))
        front = moved.where("not fails").groupBy("seed", "node", "conditions").agg(F.min(F.size("steps")).cast("long").alias("n"))
        front, count = rounds.counted(front.join(seen, ["seed", "node", "conditions"], "left_anti"))
        seen = seen.unionByName(front.select("seed", "node", "conditions"))
    out = whole.put(ends), whole.put(capped), whole.put(bad.distinct())
    rounds.clear()
    return out


def recover_entrypoints(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, observations: DataFrame, states: int | None = None) -> Entrypoints:
    """edges: edge_id, pos, src, dst, kind, condition, confidence, evidence (array of text); nodes: node, controllable;
    seeds, observations: node.

    A seed may have `states` states (by default 20,000, or one for each node if there are more); with more it is capped:
    what was found stays, and ENTRYPOINT_SLICE_CAP names it. A seed without a path is ENTRYPOINT_NOT_CONFIRMED, one that
    isn't a node MISSING_NODE. Null seeds, observations and ends of edges are none; a null condition is no guard.
    """
    results = Rounds(edges.sparkSession, "entrypoints")
    rounds = results.part("entrypoints")
    known = nodes.select("node").where("node is not null").distinct()
    if states is None:
        states = max(STATES, known.count())
    wanted = seeds.select("node").where("node is not null").distinct()
    missing = wanted.join(known, "node", "left_anti")
    wanted = rounds.put(wanted.join(known, "node", "left_semi"))
    seen_from = rounds.put(observations.select("node").where("node is not null").distinct())
    # both kinds of ways are read from one table: what leads to no seed and to nothing observed is on neither
    led = _leading(edges.where(F.col("kind").isin(*PATH, *BACKWARD)).select(*FIELDS, "dst", "kind", "confidence", "evidence"), wanted.unionByName(seen_from), rounds)
    path = led.where(F.col("kind").isin(PATH))
    controllable = rounds.put(nodes.where("controllable").select("node").distinct())
    starts = wanted.select(F.col("node").alias("search"), "node", F.lit(0).alias("distance"))
    ends_of_ways = wanted.unionByName(controllable).unionByName(seen_from)
    ways = rounds.put(corridors(path, ends_of_ways, rounds, ("edge_id", "pos")).withColumn("length", F.size("steps").cast("long")))
    short = rounds.put(ways.groupBy("src", "dst").agg(F.min("length").alias("length")))
    on = shortest(short, starts, rounds=rounds, stored=True)
    observed = rounds.put(on.join(seen_from, "node", "left_semi").select("search", F.col("node").alias("goal")))
    back = shortest(short, starts.join(observed.select("search").distinct(), "search", "left_semi"), False, rounds=rounds, stored=True)
    confirmed = rounds.put(back.join(controllable, "node", "left_semi").select(F.col("search").alias("seed"), "node"))
    live = led.where(F.col("kind").isin(BACKWARD)).select(*FIELDS, "dst")
    keep = wanted.unionByName(controllable)
    ends, capped, infeasible = _states(live, wanted, confirmed, keep, states, rounds)
    trees = rounds.part("trees")
    to_seed = laid_out(shortest_trees(ways, back, False, trees), ends.select(F.col("seed").alias("search"), F.col("node").alias("goal")).distinct(), trees)
    from_seed = laid_out(shortest_trees(ways, on, True, trees), observed, trees)
    ids = lambda rising: F.flatten(F.transform(F.col("ways") if rising else F.reverse("ways"), lambda x: x["steps"]))
    first = to_seed.select(F.col("search").alias("seed"), F.col("goal").alias("entry"), ids(True).alias("e1"))
    then = from_seed.select(F.col("search").alias("seed"), F.col("goal").alias("observation"), ids(False).alias("e2"))
    whole = rounds.put(first.join(then, "seed").select("seed", "entry", "observation", F.concat("e1", "e2").alias("edges")))
    trees.clear()
    facts = path.select("edge_id", "confidence", "evidence").groupBy("edge_id").agg(F.max("confidence").alias("confidence"), F.max("evidence").alias("evidence"))
    along = whole.select("seed", "entry", "observation", F.explode("edges").alias("edge_id")).join(facts, "edge_id")
    sums = along.groupBy("seed", "entry", "observation").agg(F.product("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"))
    around = observed.select(F.col("search").alias("seed"), F.col("goal").alias("observation")).where("seed <> observation")
    bypass = bypasses(short, rounds.put(around.distinct()), whole, rounds, stored=True)
    key = ["seed", "entry", "observation"]
    rows = ends.withColumnRenamed("node", "entry").join(whole, ["seed", "entry"]).join(sums, key, "left").join(bypass, key, "left")
    told = F.when(F.size("conditions") > 0, F.array_join(F.transform("conditions", lambda c: F.concat(F.lit("("), c, F.lit(")"))), " and ")).otherwise("True")
    paths = results.put(rows.select(*key, "conditions", told.alias("path_condition"), "edges", F.size("edges").cast("long").alias("n_edges"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), "bypass"))
    kind = lambda df, c, name: df.select(F.col(c).alias("seed"), F.lit(name).alias("kind"))
    lost = wanted.join(paths.select(F.col("seed").alias("node")).distinct(), "node", "left_anti")
    frontiers = kind(capped, "seed", "ENTRYPOINT_SLICE_CAP").unionByName(kind(lost, "node", "ENTRYPOINT_NOT_CONFIRMED")).unionByName(kind(missing, "node", "MISSING_NODE"))
    found = Entrypoints(paths, results.put(frontiers), results.put(infeasible))
    rounds.clear()
    return found


def least_conditions(paths: DataFrame) -> DataFrame:
    """Paths without those that ask for more than another of the same ends: a set of conditions goes if a smaller one is
    part of it. Sets of a group meet by their least condition only, and a group without conditions beats all others."""
    key = ["seed", "entry", "observation"]
    at = Window.partitionBy(*key)
    open_ = paths.withColumn("__least", F.min(F.size("conditions")).over(at)).where((F.col("__least") > 0) | (F.size("conditions") == 0)).drop("__least")
    sets = open_.where(F.size("conditions") > 0).select(*key, "conditions")
    small = sets.select(*key, F.col("conditions")[0].alias("c"), F.col("conditions").alias("part"))
    beaten = sets.select(*key, "conditions", F.explode("conditions").alias("c")).join(small, [*key, "c"])
    beaten = beaten.where((F.size("part") < F.size("conditions")) & (F.size(F.array_except("part", "conditions")) == 0)).select(*key, "conditions").distinct()
    return open_.join(beaten, [*key, "conditions"], "left_anti")
