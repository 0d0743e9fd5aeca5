"""Edge ledger, choice of challenges and minimal cases against plain loops."""

import random

from pyspark.sql import functions as F

from basalt.operators import ledger as le
from basalt.operators import minimise as mi
from basalt.operators import roundtrip as rt
from basalt.operators.entrypoints import PATH


def test_ledger_equals_a_plain_loop(spark):
    rng = random.Random(2)
    edges = [(f"e{k:02}", rng.choice(["calls", "data_flow", "containment"]), f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}", rng.choice([None, "True", "not (a)", "not (a)", "not (a)", "b"])) for k in range(60)]
    nodes = [(f"n{i:02}", le.UNKNOWN_TARGET if i % 5 == 0 else "call") for i in range(14)]
    held = {"p0": ["a"], "p1": [], "p2": ["b", "a"]}
    paths = []
    for k in range(12):
        at, ns, es = f"n{rng.randrange(14):02}", [], []
        ns.append(at)
        for _ in range(3):
            on = [e for e in edges if e[2] == at]
            if not on:
                break
            e = rng.choice(on)
            es.append(e[0])
            at = e[3]
            ns.append(at)
        paths.append((k % 4, f"p{k % 3}", k, ns, es, [at, ns[0]] if k % 2 else [at]))
    want = set()
    for leaf, part, path, ns, es, seen in paths:
        reach = set(seen)
        while True:
            more = {e[2] for e in edges if e[3] in reach and e[1] in PATH} - reach
            if not more:
                break
            reach |= more
        for n in set(ns):
            for i, kind, src, dst, condition in edges:
                if src != n or (i not in es and dst not in reach):
                    continue
                have = set(held[part]) | ({condition} if condition not in (None, "True") else set())
                if i in es:
                    s = ("ENUMERATED", None, None)
                elif n in seen:
                    s = ("PRESERVATION_ONLY", "post-observation-discharge", None)
                elif kind not in PATH:
                    s = ("PRESERVATION_ONLY", "structural-edge-discharge", None)
                elif any(f"not ({c})" in have for c in have):
                    s = ("PROVED_INFEASIBLE", "infeasibility-proof", None)
                else:
                    s = ("FRONTIER", None, "DYNAMIC_TARGET" if dict(nodes)[dst] == le.UNKNOWN_TARGET else "UNENUMERATED_FEASIBLE_EDGE")
                want.add((leaf, part, path, n, i, kind, *s))
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = le.edge_ledger(df([*paths, (9, "p0", 99, None, None, None)], "leaf int, partition string, path int, nodes array<string>, edges array<string>, observations array<string>"), df([*edges, ("x", "calls", None, "n00", None)], "edge_id string, kind string, src string, dst string, condition string"), df(nodes, "node string, kind string"), df(list(held.items()), "partition string, constraints array<string>"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len({r[6] for r in rows}) == 4


def test_selected_challenges(spark):
    rng = random.Random(5)
    cells = [(f"c{k:03}", f"u{rng.randrange(9)}", float(rng.randrange(6))) for k in range(80)]
    df = spark.createDataFrame([*cells, (None, "u1", 9.0), ("x", None, 9.0), ("y", "u1", None)], "challenge string, unit string, score double")
    order = sorted(cells, key=lambda c: (-c[2], c[0]))
    for most in (1, 5, 9, 30, 200):
        best = {}
        for c in order:
            best.setdefault(c[1], c)
        seeds = sorted(best.values(), key=lambda c: (-c[2], c[0]))[:most]
        rest = [c for c in order if c not in seeds][: most - len(seeds)]
        got = {tuple(r) for r in le.select_challenges(df, most).collect()}
        assert got == {(*c, True) for c in seeds} | {(*c, False) for c in rest}


def _one_by_one(parts, rules):
    kept = list(parts)
    holds = lambda have: any(set(r) <= set(have) for r in rules)
    if not holds(kept):
        return kept
    for p in parts:
        if holds([x for x in kept if x != p]):
            kept.remove(p)
    return kept


def test_minimal_cases_equal_one_by_one(spark):
    rng = random.Random(8)
    parts, rules, want = [], [], set()
    for case in range(25):
        m = rng.choice([1, 2, 7, 30])
        order = [f"p{i:02}" for i in rng.sample(range(40), m)]
        mine = [rng.sample(order, min(m, rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        if case == 3:
            mine = [["nowhere"]]
        parts += [(case, p, 10 * k) for k, p in enumerate(order)]
        rules += [(case, k, p) for k, r in enumerate(mine) for p in r]
        want |= {(case, p) for p in _one_by_one(order, mine)}
    df = spark.createDataFrame([*parts, (None, "p", 1), (3, None, 1)], "case int, part string, place int")
    got = mi.minimise(df, mi.by_rules(spark.createDataFrame(rules, "case int, rule int, part string")))
    assert {tuple(r) for r in got.collect()} == want
    assert mi.minimise(df.where(F.lit(False)), mi.by_rules(spark.createDataFrame(rules, "case int, rule int, part string"))).collect() == []


def test_graphs_come_back_whole(spark):
    """Order of rows and keys, copies and nulls don't matter; a changed or lost row does."""
    nodes = spark.createDataFrame([(1, "a", "call", None, {"k": "1", "b": None}, None), (1, "b", None, "x\ny", None, ["p"]), (2, "a", "call", "l", {}, []), (1, None, "call", "", None, None)], "graph int, " + rt.NODE)
    edges = spark.createDataFrame([(1, "e", "calls", ["a"], ["b"], None, 0.5, {"q": "é"}, None), (2, "e", "calls", ["a"], ["zz"], "True", None, None, ["p"])], "graph int, " + rt.EDGE)
    packed, digests = rt.pack_graphs(nodes, edges)
    _, again = rt.pack_graphs(nodes.union(nodes).orderBy("node"), edges)
    assert {tuple(r) for r in digests.collect()} == {tuple(r) for r in again.collect()}
    n, e, broken = rt.unpack_graphs(packed, digests)
    assert {(r.graph, r.node, r.label) for r in n.collect()} == {(1, "a", None), (1, "b", "x\ny")}
    (edge,) = e.collect()
    assert (edge.source_ids, edge.confidence, edge.attributes, edge.condition) == (["a"], 0.5, {"q": "é"}, None)
    assert [tuple(r) for r in broken.collect()] == [(2, "MISSING_NODE")]
    _, _, broken = rt.unpack_graphs(packed.where("not (graph = 1 and id = 'b')"), digests)
    assert (1, "DIGEST_MISMATCH") in {tuple(r) for r in broken.collect()}
    kept, gone, unknown = rt.remove_edges(edges, spark.createDataFrame([("e",), ("f",), (None,)], "edge_id string"))
    assert kept.count() == 0 and gone.count() == 2 and [r.edge_id for r in unknown.collect()] == ["f"]
