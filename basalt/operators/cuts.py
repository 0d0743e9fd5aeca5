"""Repair cuts with their own blast: how far each node reaches, for all nodes at once, and the cut that covers all units.

Reach is counted by theta sketches (a set of the least hashes), never by pairs: nodes that lead nowhere go into the sketches
of what leads to them and their edges are read no more, cycles are made one node, chains are added up by doubling steps, and
what branches takes its targets' sketches once they are whole. A sketch of SKETCH values is the
set itself up to that many nodes, so counts are exact up to it, and estimates with an error of some 3 % beyond.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import hops, impact_cone, picked_in_batches, reachable, searched_components
from .store import Rounds, ranked

#: Relations forward and (further ones) backward; what is counted at most; distance of what none observes.
FORWARD = ["control_flow", "control_dependency", "calls", "may_call", "parameter_flow", "return_flow", "exception_flow", "data_flow", "def_use", "field_flow", "state_read", "state_write", "dispatch", "protocol_selected", "protocol_candidate"]
BACKWARD = [*FORWARD, "alias", "exports", "registers", "inheritance", "override", "triggers"]
INSERTIONS = ["control_flow", "calls", "data_flow"]
MOST, FAR = 1000, 1000
#: Power of two of the values that a sketch holds: more than MOST.
SKETCH = 10


def reach_sizes(edges: DataFrame, nodes: DataFrame, counted: Column | None = None, bits: int = SKETCH) -> DataFrame:
    """node, reach: how many nodes (those that `counted` is true of) a node reaches, itself included.

    edges: src, dst; nodes: node and what `counted` reads. Exact up to 2^bits, estimated beyond. Ends that aren't in
    nodes are nodes that don't count. Rounds: as many as the longest way has branching nodes, and the logarithm of its
    longest chain.
    """
    whole = Rounds(edges.sparkSession, "reach")
    rounds, first, scc, raw = whole.part("reach"), whole.part("reach"), whole.part("scc"), whole.part("pairs")
    pairs = raw.put(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst"))
    known = nodes.where("node is not null").select("node", (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counted"), F.lit(False).alias("leads"))
    end = lambda c, leads: pairs.select(F.col(c).alias("node"), F.lit(False).alias("counted"), F.lit(leads).alias("leads"))
    every = known.unionByName(end("src", True)).unionByName(end("dst", False))
    every = rounds.put(every.groupBy("node").agg(F.max("counted").alias("counted"), F.max("leads").alias("leads")))
    # an edge to what leads nowhere only adds that node to its source's own, so no later step reads it
    split = first.put(pairs.join(every.withColumnRenamed("node", "dst"), "dst").where("counted or leads"))
    raw.clear()
    dag = first.put(split.where("leads").select("src", "dst").distinct())
    cyclic = rounds.put(searched_components(dag, scc).where("size > 1").select("node", "component"))
    scc.clear()
    held = every.select("node", F.when(F.col("counted"), F.col("node").cast("string")).alias("name")).unionByName(split.where("not leads").select(F.col("src").alias("node"), F.col("dst").cast("string").alias("name")))
    if cyclic.isEmpty():  # each node is a component
        member = every.select("node", F.col("node").alias("c"))
        held = held.withColumnRenamed("node", "c")
    else:
        within = lambda df: df.join(cyclic, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        member, held = rounds.put(within(every.select("node"))), within(held)
        of = lambda end: cyclic.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        led = dag.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst"))
        dag = first.put(led.where("src <> dst").distinct())
    base = rounds.put(held.groupBy("c").agg(F.theta_sketch_agg("name", bits).alias("own")))
    outs = dag.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to"))
    chain = rounds.put(outs.where("n = 1").select(F.col("src").alias("c"), "to").join(base, "c").select("c", "to", F.col("own").alias("sketch"), F.lit(True).alias("moved")))
    while not chain.where("moved").isEmpty():
        ahead = chain.select(F.col("c").alias("to"), F.col("to").alias("then"), F.col("sketch").alias("more"))
        both = F.when(F.col("more").isNull(), F.col("sketch")).otherwise(F.theta_union("sketch", "more", F.lit(bits)))
        chain = rounds.put(chain.join(ahead, "to", "left").select("c", F.coalesce("then", "to").alias("to"), both.alias("sketch"), F.col("then").isNotNull().alias("moved")))
    inside = chain.select(F.col("c").alias("dst"), F.col("to").alias("end"), F.col("sketch").alias("along"))
    wide = dag.join(chain.select(F.col("c").alias("src")), "src", "left_anti").join(inside, "dst", "left")
    open_ = whole.part("left")  # the edges that are left, cleared as soon as fewer are
    left, n = open_.counted(wide.select("src", F.coalesce("end", "dst").alias("dst"), "along"))
    first.clear()
    anchors = base.join(chain.select("c"), "c", "left_anti")
    done = rounds.put(anchors.join(left.select(F.col("src").alias("c")), "c", "left_anti").select("c", F.col("own").alias("sketch")))
    while n:
        waits = rounds.put(left.join(done.select(F.col("c").alias("dst")), "dst", "left_anti").select("src").distinct())
        ready = left.join(waits, "src", "left_anti")
        pieces = ready.select("src", "dst").join(done.withColumnsRenamed({"c": "dst", "sketch": "far"}), "dst").select("src", "far")
        pieces = pieces.unionByName(ready.where("along is not null").select("src", F.col("along").alias("far")))
        come = pieces.groupBy(F.col("src").alias("c")).agg(F.theta_union_agg("far", F.lit(bits)).alias("far"))
        done = done.unionByName(rounds.put(come.join(base, "c").select("c", F.theta_union("own", "far", F.lit(bits)).alias("sketch"))))
        past, open_ = open_, whole.part("left")
        left, n = open_.counted(left.join(waits, "src", "left_semi"))
        past.clear()
    far = done.withColumnsRenamed({"c": "to", "sketch": "far"})
    chained = chain.join(far, "to").select("c", F.theta_union("sketch", "far", F.lit(bits)).alias("sketch"))
    sizes = done.unionByName(chained).select("c", F.theta_sketch_estimate("sketch").alias("reach"))
    out = whole.put(member.join(sizes, "c").select("node", "reach"))
    for part in (rounds, open_):
        part.clear()
    return out


def best_cover(covers: DataFrame, scores: DataFrame) -> DataFrame:
    """round, node, gain: greedy picks by (new units, score, node), the greatest first, until no unit is left.

    covers: node, unit; scores: node, score. Picks come in batches, each from one bounded table of the first nodes.
    """
    rounds = Rounds(covers.sparkSession, "best")
    left = rounds.put(covers.select("node", "unit").where("node is not null and unit is not null").distinct().join(scores.select("node"), "node", "left_semi"))
    done = picked_in_batches(left, scores.select("node", F.lit(1.0).alias("cost"), "score"), rounds, greatest=True)
    return ranked(done, [F.desc("gain"), F.desc("score"), F.desc("node")], "round", rounds).select("round", "node", "gain")


class Ranked(NamedTuple):
    """ranked: node, covered, distance, blast, conflicts, score, rank; between, legal: node; slices, covers: unit, node."""

    ranked: DataFrame
    between: DataFrame
    legal: DataFrame
    slices: DataFrame
    covers: DataFrame


def ranked_nodes(edges: DataFrame, nodes: DataFrame, entries: DataFrame, observations: DataFrame, units: DataFrame | None = None) -> Ranked:
    """Legal nodes between entries (forward) and observations (backward), the best first: 10 for each unit, less the
    distance to an observation, a twentieth of what the node reaches (counted up to 1000) and 3 for each test it covers.

    edges: edge_id, kind, src, dst; nodes: node, kind, legal (may it be changed?), is_test; entries, observations: node;
    units: unit, node (by default one unit of all that lies between).
    """
    rounds = Rounds(edges.sparkSession, "repair")
    every = rounds.put(edges.where(F.col("kind").isin(BACKWARD) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst", F.col("kind").isin(FORWARD).alias("on")).distinct())
    forward = rounds.put(reachable(every.where("on"), entries.select("node").distinct(), stored=True))
    # what lies between is reached from the entries, so nothing counts that can't be reached from there
    scope = rounds.put(reachable(every, forward, stored=True))
    inside = rounds.put(every.join(scope.select(F.col("node").alias("src")), "src", "left_semi"))
    on = rounds.put(inside.where("on").select("src", "dst"))
    back = reachable(inside, observations.select("node").distinct(), forward=False)
    between = rounds.put(forward.join(back, "node", "left_semi"))
    legal = rounds.put(between.join(nodes.where("legal").select("node").distinct(), "node", "left_semi"))
    near = hops(on, observations.select("node").distinct(), forward=False).withColumnRenamed("hops", "distance")
    slices = rounds.put(units.select("unit", "node").distinct() if units is not None else between.select(F.lit("unit").alias("unit"), "node"))
    covers = rounds.put(slices.join(legal, "node", "left_semi"))
    blast = reach_sizes(on, nodes.join(scope, "node", "left_semi")).select("node", F.least("reach", F.lit(MOST)).alias("blast"))
    covering = rounds.put(edges.where("kind = 'test_coverage' and src is not null and dst is not null").select("src", "dst").distinct())
    tested = rounds.put(reachable(covering, legal, stored=True))
    covering = covering.join(tested.select(F.col("node").alias("src")), "src", "left_semi")
    tests = reach_sizes(covering, nodes.join(tested, "node", "left_semi"), F.col("is_test")).select("node", F.least("reach", F.lit(MOST)).alias("conflicts"))
    rows = legal.join(covers.groupBy("node").agg(F.count("*").alias("covered")), "node", "left").join(near, "node", "left").join(blast, "node", "left").join(tests, "node", "left")
    rows = rows.select("node", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), F.coalesce("distance", F.lit(FAR)).cast("long").alias("distance"), F.coalesce("blast", F.lit(1)).cast("long").alias("blast"), F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))
    score = F.round(F.col("covered") * 10.0 - F.col("distance") - 0.05 * F.col("blast") - 3.0 * F.col("conflicts"), 6)
    places = rounds.put(ranked(rows.withColumn("score", score), [F.desc("score"), F.asc("node")], "rank", rounds))
    return Ranked(places, between, legal, slices, covers)


def causal_repair_cut(edges: DataFrame, nodes: DataFrame, entries: DataFrame, observations: DataFrame, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked as in `ranked_nodes`; roles: role, id).

    Roles: selected (the cover; without units to cover the best node), boundary (legal sources of flow into those),
    excluded (between, but not legal), covered and uncovered (units), impact (what a change of the selected reaches).
    Nothing between gives no rows.
    """
    rounds = Rounds(edges.sparkSession, "roles")
    places, between, legal, slices, covers = ranked_nodes(edges, nodes, entries, observations, units)
    picked = rounds.put(best_cover(covers, places).select("node"))
    selected = picked if not picked.isEmpty() else rounds.put(places.where("rank = 1").select("node"))
    fair = nodes.where("legal").select("node").distinct()
    boundary = edges.where(F.col("kind").isin(INSERTIONS)).join(selected.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(fair, "node", "left_semi")
    named = slices.select("unit").distinct()
    hit = covers.join(selected, "node", "left_semi").select("unit").distinct()
    none = edges.sparkSession.createDataFrame([], "frontier string, owner string, status string")
    cone = impact_cone(edges, nodes, selected, none).where("role = 'downstream'").select(F.col("id").alias("node"))
    role = lambda df, name, c="node": df.select(F.lit(name).alias("role"), F.col(c).cast("string").alias("id"))
    roles = role(selected, "selected").unionByName(role(boundary, "boundary")).unionByName(role(between.join(legal, "node", "left_anti"), "excluded"))
    roles = roles.unionByName(role(hit, "covered", "unit")).unionByName(role(named.join(hit, "unit", "left_anti"), "uncovered", "unit")).unionByName(role(cone, "impact"))
    return places, rounds.put(roles)
