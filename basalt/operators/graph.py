"""Directed hypergraphs as edge tables: adjacency, reachability, hops, components, cones, cuts and covers.

edges: src, dst (strings) and further columns. Loops are level-synchronous joins over a table of rounds; each ends
when a round adds nothing. Nulls never match a key, so edges with a null end are dead.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Rounds, ranked

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
#: Edges that one task finishes by itself; more go through distributed rounds first.
TASK_EDGES = 2_000_000


def hyperedge_pairs(hyper: DataFrame, keep: list[str]) -> DataFrame:
    """Every source x target pair of each hyperedge."""
    return hyper.select(*keep, F.explode("source_ids").alias("src"), "target_ids").select(*keep, "src", F.explode("target_ids").alias("dst"))


def neighbours(edges: DataFrame, node: str, kinds: list[str] | None = None, forward: bool = True) -> DataFrame:
    here, there = ("src", "dst") if forward else ("dst", "src")
    rows = edges.where(F.col(here) == node)
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    return rows.select(F.col(there).alias("node")).distinct()


def hops(edges: DataFrame, start: DataFrame, forbidden: list[str] | None = None, stop: Column | None = None, most: int | None = None, forward: bool = True, stored: bool = False) -> DataFrame:
    """(node, hops) of everything reached from start (column node). forbidden nodes are never entered; nodes where
    `stop` holds are reached but not left; at most `most` hops. stored: edges are a table already, and not laid down again."""
    e = edges.select("src", "dst") if forward else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if forbidden:
        e = e.where(~F.col("dst").isin(forbidden))
        start = start.where(~F.col("node").isin(forbidden))
    rounds = Rounds(edges.sparkSession, "hops")
    e = e if stored else rounds.put(e.distinct())
    seen = frontier = rounds.put(start.select("node").distinct().withColumn("hops", F.lit(0)))
    level = 0
    while most is None or level < most:
        level += 1
        leave = frontier.where(~stop) if stop is not None else frontier
        step = e.join(leave.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier, n = rounds.counted(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(level)))
        if not n:
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable(edges: DataFrame, start: DataFrame, **how) -> DataFrame:
    return hops(edges, start, **how).select("node")


def _local_scc(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected components of one bounded edge list (depth-first search without recursion)."""
    got = list(frames)
    if not got:
        return
    e = pd.concat(got)
    out: dict[str, list[str]] = {}
    for a, b in zip(e.src, e.dst, strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    rows = []
    for root in sorted(out):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        path = [(root, iter(out[root]))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    on.add(w)
                    path.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    first = min(members)
                    rows += [(m, first, len(members)) for m in members]
    yield pd.DataFrame(rows, columns=["node", "component", "size"])


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component, size): component is its least node. Nodes that no cycle can hold (no edge in, or none out) are
    peeled in distributed rounds while more edges are left than one task takes; then colouring rounds split the rest."""
    rounds = Rounds(edges.sparkSession, "scc")
    e = rounds.put(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    known = searched_components(e, rounds, task_edges)
    alone = nodes.join(known, "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    return known.unionByName(alone)


def searched_components(e: DataFrame, rounds: Rounds, task_edges: int = TASK_EDGES) -> DataFrame:
    """`strong_components` of stored edges (src, dst: distinct, no nulls), without those of nodes that were peeled."""
    done: DataFrame | None = None
    n = e.count()
    while n > task_edges:
        inner = e.where("src <> dst")
        trimmed = rounds.put(e.join(inner.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        left = trimmed.count()
        if left > 0.9 * n:
            colour = _spread_least(trimmed, rounds)
            inside = trimmed.join(colour.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"node": "dst", "c": "cd"}), "dst").where("cs = cd")
            back = _back_from_roots(inside, rounds)
            sized = back.groupBy("component").agg(F.count("*").alias("size"))
            found = rounds.put(back.join(sized, "component").select("node", "component", "size"))
            done = found if done is None else done.unionByName(found)
            trimmed = rounds.put(inside.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
            left = trimmed.count()
        e, n = trimmed, left
    local = e.coalesce(1).mapInPandas(_local_scc, "node string, component string, size long")
    return rounds.put(local if done is None else done.unionByName(local))


def _spread_least(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, c): the least node that reaches it."""
    c = rounds.put(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("c", F.col("node")))
    while True:
        come = edges.join(c.withColumnsRenamed({"node": "src"}), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("n"))
        new = rounds.put(c.join(come, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), F.col("c").alias("old")))
        c = new.select("node", "c")
        if not new.where("c <> old").limit(1).count():
            return c


def _back_from_roots(inside: DataFrame, rounds: Rounds) -> DataFrame:
    """Inside one colour: what reaches the colour's own node is its component."""
    seen = front = rounds.put(inside.where("dst = cd").select(F.col("dst").alias("node"), F.col("cd").alias("component")).distinct())
    while True:
        step = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.col("cs").alias("component")).distinct()
        front = rounds.put(step.join(seen, ["node"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): undirected; component is the least node.

    A round hangs each node under its least neighbour, shortens these trees to their roots, and contracts the edges to
    the roots: edges inside a tree vanish and parallel ones fall together, so each round's table is a fraction of the
    last one's. Hubs are split: a node's neighbours are reduced to their least one before the shuffle.
    """
    rounds = Rounds(edges.sparkSession, "cc")
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    alone = rounds.put(ends.select(F.col("src").alias("node")).union(ends.select("dst")).distinct())
    left = rounds.put(ends.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    tops: DataFrame | None = None  # node, component so far
    while left.limit(1).count():
        near = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        tree = rounds.put(near.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("up")))
        while True:
            higher = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = rounds.put(tree.join(higher, "up").select("node", "up", "top"))
            tree = step.select("node", F.col("top").alias("up"))
            if not step.where("up <> top").limit(1).count():
                break
        if tops is None:
            tops = tree.select("node", F.col("up").alias("component"))
        else:
            moved = tree.select(F.col("node").alias("component"), "up")
            tops = rounds.put(tops.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        ups = [tree.select(F.col("node").alias(c), F.col("up").alias(f"u{c}")) for c in ("a", "b")]
        far = left.join(ups[0], "a").join(ups[1], "b").where("ua <> ub")
        left = rounds.put(far.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if tops is None:
        return alone.select("node", F.col("node").alias("component"))
    return alone.join(tops, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def shortest_path(edges: DataFrame, start: str, goal: str, forbidden: list[str] | None = None) -> DataFrame:
    """place, node, edge_id (by which it is entered; null at the start): the first shortest path, no row if there is none.

    edges: edge_id, src, dst, pos (the target's place in its hyperedge). Of all shortest paths the one with the least
    sequence of (edge_id, pos) is taken, which is the one that a search finds that visits edges in this order. A
    forbidden start or goal has no path. The path is laid out by doubling steps, in as many rounds as its length has bits.
    """
    banned = forbidden or []
    if start in banned or goal in banned:
        return edges.limit(0).select(F.lit(0).alias("place"), F.col("dst").alias("node"), "edge_id")
    spark, rounds = edges.sparkSession, Rounds(edges.sparkSession, "path")
    open_ = rounds.put(edges.where(~F.col("src").isin(banned) & ~F.col("dst").isin(banned)).select("edge_id", "src", "dst", "pos"))
    far = hops(open_, spark.createDataFrame([(goal,)], "node string"), stop=F.col("node") == start, forward=False)
    d = [far.select(F.col("node").alias(c), F.col("hops").alias(f"d{c}")) for c in ("src", "dst")]
    down = open_.join(d[0], "src").join(d[1], "dst").where("dsrc = ddst + 1")
    jump = rounds.put(down.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("edge_id", "pos", "dst")).alias("x")).select("node", "x.edge_id", F.col("x.dst").alias("to")))
    found = far.where(F.col("node") == start).select(F.lit(0).alias("place"), "node", F.lit(None).cast(open_.schema["edge_id"].dataType).alias("edge_id"))
    length = 1
    first = found.limit(1).count()
    leap = jump
    while first:
        new = found.join(leap, "node").select((F.col("place") + length).alias("place"), F.col("to").alias("node"))
        new = rounds.put(new)
        if not new.limit(1).count():
            break
        found = rounds.put(found.select("place", "node").unionByName(new))
        after = leap.select(F.col("node").alias("to"), F.col("to").alias("then"))
        leap = rounds.put(leap.join(after, "to").select("node", F.col("then").alias("to")))
        length *= 2
    entered = found.select((F.col("place") + 1).alias("place"), "node").join(jump.select("node", "edge_id"), "node").select("place", "edge_id")
    return found.select("place", "node").join(entered, "place", "left").select("place", "node", "edge_id")


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the new ones, rejected: edge_id, reason). Edges: edge_id, kind, source_ids, target_ids, condition,
    confidence; nodes: node. An edge with an unknown end is rejected, and so is one whose id another edge has; the same
    edge again changes nothing."""
    ends = new.select("edge_id", F.explode(F.array_union("source_ids", "target_ids")).alias("node"))
    lost = ends.join(nodes.select("node"), "node", "left_anti").select("edge_id").distinct().withColumn("lost", F.lit(True))
    columns = [c for c in edges.columns if c != "edge_id"]
    was = edges.select("edge_id", F.struct(*columns).alias("was"))
    first = new.groupBy("edge_id").agg(F.min(F.struct(*columns)).alias("now"), F.max(F.struct(*columns)).alias("last"))
    rows = first.join(lost, "edge_id", "left").join(was, "edge_id", "left")
    reason = F.when(F.col("lost"), "MISSING_NODE").when((F.col("now") != F.col("last")) | ~F.coalesce("was", "now").eqNullSafe(F.col("now")), "ID_COLLISION")
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null and was is null").select("edge_id", "now.*")
    return edges.unionByName(good), judged.where("reason is not null").select("edge_id", "reason")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of `gone` (column node) and all edges that touch one."""
    touched = edges.select("edge_id", F.explode(F.array_union("source_ids", "target_ids")).alias("node")).join(gone.select("node").distinct(), "node", "left_semi").select("edge_id").distinct()
    return nodes.join(gone.select("node").distinct(), "node", "left_anti"), edges.join(touched, "edge_id", "left_anti")


#: Relations that carry a change on.
IMPACT_RELATIONS = ["calls", "may_call", "return_flow", "exception_flow", "raises", "catches", "data_flow", "def_use", "alias", "field_flow", "state_read", "state_write", "dispatch", "protocol_selected", "protocol_candidate", "protocol_fallback", "serializes", "external_effect", "observes", "test_coverage"]
CONSUMERS = ["call_site", "branch", "protocol_operation", "external_interface", "observation_point"]


def impact_cone(edges: DataFrame, nodes: DataFrame, sources: DataFrame, frontiers: DataFrame, relations: list[str] = IMPACT_RELATIONS) -> DataFrame:
    """role, id: what a change of the sources (column node) reaches, and what that is.

    edges: edge_id, kind, src, dst; nodes: node, kind, is_test; frontiers: frontier, owner, status. Roles: downstream,
    affected_edge (both ends inside), caller, consumer, handler, serializer, preservation_test, frontier.
    """
    rounds = Rounds(edges.sparkSession, "cone")
    live = edges.where(F.col("kind").isin(relations))
    inside = rounds.put(reachable(live, sources.select("node").distinct()))
    role = lambda df, c, name: df.select(F.lit(name).alias("role"), F.col(c).cast("string").alias("id"))
    to = inside.select(F.col("node").alias("dst"))
    at = inside.select(F.col("node").alias("src"))
    entering = edges.join(to, "dst", "left_semi")
    leaving = edges.join(at, "src", "left_semi")
    known = nodes.join(inside, "node", "left_semi")
    serial = F.col("kind") == "serializes"
    parts = [
        role(inside, "node", "downstream"),
        role(live.join(at, "src", "left_semi").join(to, "dst", "left_semi"), "edge_id", "affected_edge"),
        role(entering.where(F.col("kind").isin("calls", "may_call")), "src", "caller"),
        role(known.where(F.col("kind").isin(CONSUMERS)), "node", "consumer"),
        role(known.where("kind = 'exception'"), "node", "handler"),
        role(entering.where(F.col("kind").isin("catches", "exception_flow")), "dst", "handler"),
        role(entering.where(serial), "dst", "serializer"),
        role(leaving.where(serial), "src", "serializer"),
        role(known.where("is_test"), "node", "preservation_test"),
        role(frontiers.where("status = 'OPEN'").join(inside.select(F.col("node").alias("owner")), "owner", "left_semi"), "frontier", "frontier"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def repair_cut(edges: DataFrame, nodes: DataFrame, entries: DataFrame, observations: DataFrame, units: DataFrame, blast: DataFrame) -> DataFrame:
    """node, covered, distance, score of every legal node between entries and observations; the best first has rank 1.

    edges: src, dst (those a change flows along); nodes: node, legal; entries, observations: node; units: unit, node (a
    unit's slice); blast: node, blast, conflicts (how far a change of it reaches, and how many tests it meets). A node's
    score is 10 for each unit it is in, less its distance to the nearest observation, a twentieth of its blast and 3 per
    conflict.
    """
    rounds = Rounds(edges.sparkSession, "cut")
    flow = rounds.put(edges.select("src", "dst").distinct())
    forward = reachable(flow, entries)
    back = hops(flow, observations, forward=False).withColumnRenamed("hops", "distance")
    between = back.join(forward, "node", "left_semi").join(nodes.where("legal").select("node"), "node", "left_semi")
    covered = units.groupBy("node").agg(F.countDistinct("unit").alias("covered"))
    rows = between.join(covered, "node", "left").join(blast, "node", "left").na.fill(0, ["covered", "blast", "conflicts"])
    score = F.col("covered") * 10.0 - F.col("distance") - 0.05 * F.col("blast") - 3.0 * F.col("conflicts")
    scored = rows.select("node", F.col("covered").cast("long").alias("covered"), F.col("distance").cast("long").alias("distance"), F.round(score, 6).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("node")], "rank", rounds)


def path_confidence(paths: DataFrame, by: list[str], confidence: str) -> DataFrame:
    """Product of the confidences of each path's edges."""
    return paths.groupBy(*by).agg(F.product(confidence).alias("confidence"))


def set_cover(covers: DataFrame, costs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Greedy cover. covers: node, unit; costs: node, cost. Picks by (gain / cost, gain, least node) until no unit is
    left, or `most` picks; a row per pick: round, node, gain. Nulls are no nodes and no units.

    Picks come in batches, each from one bounded table of the first nodes; sorting them gives the greedy order. With
    `most`, one bounded row comes to the driver for each pick.
    """
    rounds = Rounds(covers.sparkSession, "cover")
    left = rounds.put(covers.select("node", "unit").where("node is not null and unit is not null").distinct())

    def gains(left: DataFrame) -> DataFrame:
        gain = left.groupBy("node").agg(F.count("*").alias("gain"))
        gain = gain.join(costs, "node", "left") if costs is not None else gain.withColumn("cost", F.lit(1.0))
        return gain.select("node", "gain", (F.col("gain") / F.greatest(F.coalesce("cost", F.lit(1.0)), F.lit(1e-9))).alias("ratio"))

    if most is not None:
        picks: list[tuple[int, str, int]] = []
        for k in range(1, most + 1):
            best = gains(left).orderBy(F.desc("ratio"), F.desc("gain"), "node").first()
            if best is None:
                break
            picks.append((k, best["node"], best["gain"]))
            hit = left.where(F.col("node") == best["node"]).select("unit")
            left = rounds.put(left.join(hit, "unit", "left_anti").select("node", "unit"))
        return covers.sparkSession.createDataFrame(picks, "round int, node string, gain long")
    done = picked_in_batches(left, costs.select("node", "cost", F.lit(0.0).alias("score")) if costs is not None else None, rounds)
    return ranked(done, [F.desc("ratio"), F.desc("gain"), F.asc("node")], "round", rounds).select("round", "node", "gain")


def picked_in_batches(left: DataFrame, facts: DataFrame | None, rounds: Rounds, greatest: bool = False, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, gain, score, ratio of greedy picks by (gain / cost, gain, score, least or greatest node) until no unit is left.
    left: node, unit, each pair once; facts: node, cost, score (by default 1 and 0).

    A round brings the first nodes, as many as have at most `task_edges` pairs together, to one task, which picks from them
    while the best comes before the first node outside: gains only shrink, so none outside can come before. The units of
    these picks go, and the next round starts. The first of all is always picked; alone, if it has more units than that.
    """
    order = [F.desc("ratio"), F.desc("gain"), F.desc("score"), F.desc("node") if greatest else F.asc("node")]
    back = [F.asc("ratio"), F.asc("gain"), F.asc("score"), F.asc("node") if greatest else F.desc("node")]
    done: DataFrame | None = None
    while True:
        gain = left.groupBy("node").agg(F.count("*").alias("gain"))
        gain = gain.join(facts, "node", "left") if facts is not None else gain.withColumns({"cost": F.lit(1.0), "score": F.lit(0.0)})
        cost = F.greatest(F.coalesce("cost", F.lit(1.0)), F.lit(1e-9)).cast("double")
        now = rounds.put(gain.select("node", "gain", cost.alias("cost"), F.coalesce("score", F.lit(float("-inf"))).cast("double").alias("score"), (F.col("gain") / cost).alias("ratio")))
        most, total = now.agg(F.max("gain"), F.sum("gain")).first()
        done = now.select("node", "gain", "score", "ratio").limit(0) if done is None else done
        if not total:
            return done
        if most > task_edges:
            new = rounds.put(now.orderBy(*order).limit(1).select("node", "gain", "score", "ratio"))
        else:
            inside = now
            batch = left.join(now, "node")
            if total > task_edges:  # then there are more nodes than a batch holds
                head = rounds.put(now.orderBy(*order).limit(task_edges // most + 1))
                bound = rounds.put(head.orderBy(*back).limit(1))
                inside = head.join(bound.select("node"), "node", "left_anti")
                batch = left.join(inside, "node").unionByName(bound.withColumn("unit", F.lit(None).cast(left.schema["unit"].dataType)))
            picks = batch.select("node", "unit", "gain", "cost", "score").repartition(1).mapInPandas(partial(_picks, greatest), done.select("node", "gain").schema)
            new = rounds.put(picks.join(inside.select("node", "cost", "score"), "node").select("node", "gain", "score", (F.col("gain") / F.col("cost")).alias("ratio")))
        done = done.unionByName(new)
        hit = left.join(new.select("node"), "node", "left_semi").select("unit").distinct()
        left = rounds.put(left.join(hit, "unit", "left_anti").select("node", "unit"))


def _picks(greatest: bool, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy picks of one bounded table (node, unit, gain, cost, score) while they come before the row without a unit."""
    got = [f for f in frames if len(f)]
    if not got:
        return
    e = pd.concat(got, ignore_index=True)
    place = e.drop_duplicates("node").sort_values("node", ascending=not greatest, kind="stable").sort_values("score", ascending=False, kind="stable").drop(columns="unit").reset_index(drop=True)
    key = lambda i, gain: (-(gain / cost[i]), -gain, i)
    cost, gains = place["cost"].tolist(), place["gain"].tolist()
    at = e["node"].map(pd.Series(place.index, index=place["node"]))
    units, _ = pd.factorize(e["unit"])  # -1: none
    covered = pd.Series(False, index=range(units.max() + 1)).to_numpy()
    own = {i: units[rows] for i, rows in at.groupby(at).indices.items()}
    last = [key(i, gains[i]) for i, u in own.items() if u[0] < 0]
    heap = sorted(key(i, gains[i]) for i, u in own.items() if u[0] >= 0)
    picked = []
    while heap and not (last and last[0] < heap[0]):
        _, was, i = heapq.heappop(heap)
        gain = int((~covered[own[i]]).sum())
        if gain == -was:
            picked.append((i, gain))
            covered[own[i]] = True
        elif gain:
            heapq.heappush(heap, key(i, gain))
    yield pd.DataFrame({"node": place["node"].iloc[[i for i, _ in picked]].to_numpy(), "gain": [g for _, g in picked]})


def skyline(rows: DataFrame, key: str, low: str, high: str, ranges: int = 64) -> DataFrame:
    """Rows that no other beats: least `low`, most `high`, one of them strictly. low: a number.

    A row survives if its `high` beats the best of every row with a lesser `low`; best per `low` first. Values of `low`
    are cut into ranges: each range is scanned by itself, and starts from the best of all ranges before it.
    """
    from pyspark.sql import Window

    best = rows.where(F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(low).agg(F.max(high).alias("__best"))
    cuts = sorted(set(best.approxQuantile(low, [i / ranges for i in range(1, ranges)], 0.005)))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(low))) if cuts else F.lit(0)
    best = best.withColumn("__range", at)
    tops = best.groupBy("__range").agg(F.max("__best").alias("__top"))
    past = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    tops = tops.select("__range", F.max("__top").over(past).alias("__past"))
    earlier = Window.partitionBy("__range").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    scanned = best.withColumn("__here", F.max("__best").over(earlier)).join(F.broadcast(tops), "__range")
    before = F.greatest("__here", "__past")
    edge = scanned.where(before.isNull() | (F.col("__best") > before)).select(low, "__best")
    return rows.join(edge, low).where(F.col(high) == F.col("__best")).select(key, low, high)
