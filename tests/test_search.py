"""Many searches, entrypoints, cuts and maintained graphs against plain loops."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from basalt.operators import cuts, search
from basalt.operators import entrypoints as ep
from basalt.operators import incremental as inc


def _graph(rng, n, m):
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})


def _distances(pairs, starts, banned=()):
    """Of one search: starts are (node, distance)."""
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    best = {}
    todo = sorted((d, n) for n, d in starts if n not in banned)
    while todo:
        d, n = todo.pop(0)
        if n in best:
            continue
        best[n] = d
        todo += [(d + 1, x) for x in out[n] if x not in best and x not in banned]
        todo.sort()
    return best


def test_searches_equal_one_by_one(spark):
    rng = random.Random(6)
    pairs = _graph(rng, 40, 70)
    starts = [(s, f"n{rng.randrange(40):02}", d) for s in range(12) for d in (0, 0, 3)] + [(0, None, 0), (None, "n00", 0)]
    banned = [(s, f"n{rng.randrange(40):02}") for s in range(12)]
    edges = spark.createDataFrame([*pairs, ("n00", None)], "src string, dst string")
    df = spark.createDataFrame(starts, "search int, node string, distance int")
    stop = spark.createDataFrame(banned, "search int, node string")
    want = {(s, n): d for s in range(12) for n, d in _distances(pairs, [(b, d) for a, b, d in starts if a == s and b], {b for a, b in banned if a == s}).items()}
    got, cut = search.spread(edges, df, forbidden=stop)
    assert {(r.search, r.node): r.distance for r in got.collect()} == want and cut.count() == 0
    ways = edges.withColumn("length", F.lit(1))
    assert {(r.search, r.node): r.distance for r in search.shortest(ways, df, forbidden=stop).collect()} == want
    got, cut = search.spread(edges, df, most=7, forbidden=stop)
    lists = defaultdict(list)
    for (s, n), d in want.items():
        lists[s].append((d, n))
    assert {(r.search, r.distance, r.node) for r in got.collect()} == {(s, *x) for s, rows in lists.items() for x in sorted(rows)[:7]}
    assert {r.search for r in cut.collect()} == {s for s, rows in lists.items() if len(rows) > 7}
    back, _ = search.spread(edges, df, forward=False)
    turned = [(b, a) for a, b in pairs]
    assert {(r.search, r.node): r.distance for r in back.collect()} == {(s, n): d for s in range(12) for n, d in _distances(turned, [(b, d) for a, b, d in starts if a == s and b]).items()}


def test_long_chains_take_few_rounds(spark):
    """2000 nodes in a row: corridors are laid together before anything is searched."""
    n = 2000
    edges = [(f"e{i:05}", 0, f"{i:05}", f"{i + 1:05}", "data_flow", "g" if i == 1500 else None, 0.999, ["x"]) for i in range(n - 1)]
    e = spark.createDataFrame(edges, "edge_id string, pos int, src string, dst string, kind string, condition string, confidence double, evidence array<string>")
    nodes = spark.createDataFrame([(f"{i:05}", i == 3) for i in range(n)], "node string, controllable boolean")
    one = lambda v: spark.createDataFrame([(v,)], "node string")
    got = ep.recover_entrypoints(e, nodes, one("01900"), one("01999"))
    (row,) = got.paths.collect()
    assert (row.entry, row.n_edges, row.path_condition, row.bypass) == ("00003", 1996, "(g)", None)
    assert row.edges[0] == "e00003" and row.edges[-1] == "e01998" and abs(row.confidence - 0.999**1996) < 1e-9
    assert got.frontiers.collect() == [] and got.infeasible.collect() == []
    empty = ep.recover_entrypoints(e.limit(0), nodes, one("01900"), one("01999"))
    assert empty.paths.collect() == [] and [r.kind for r in empty.frontiers.collect()] == ["ENTRYPOINT_NOT_CONFIRMED"]


CONDITIONS = [None, "True", "a", "not (a)", "b", "iterable(x)", "not (b)"]


def _plain_entrypoints(edges, nodes, seeds, observations, states):
    """One seed after another; edges: (edge_id, pos, src, dst, kind, condition)."""
    path = [e for e in edges if e[4] in ep.PATH]
    into = defaultdict(list)
    for e in edges:
        if e[4] in ep.BACKWARD:
            into[e[3]].append(e)
    pairs, turned = [(e[2], e[3]) for e in path], [(e[3], e[2]) for e in path]
    found, frontiers, bad = set(), set(), set()
    for seed in seeds:
        if seed not in nodes:
            frontiers.add((seed, "MISSING_NODE"))
            continue
        back, on = _distances(turned, [(seed, 0)]), _distances(pairs, [(seed, 0)])
        obs = [o for o in observations if o in on]
        confirmed = {n for n in back if nodes[n]} if obs else set()
        seen, front = set(), [(seed, ())]
        ends = set()
        while front:
            node, cs = front.pop()
            if (node, cs) in seen:
                continue
            if any(f"not ({c})" in cs for c in cs):
                bad.add(node)
                continue
            seen.add((node, cs))
            if node in confirmed:
                ends.add((node, cs))
                continue
            for e in into[node]:
                guard = () if e[5] in (None, "True") else (e[5],)
                front.append((e[2], tuple(sorted({*cs, *guard}))))
        if len(seen) > states:
            frontiers.add((seed, "ENTRYPOINT_SLICE_CAP"))
        any_path = False
        for node, cs in ends:
            ids, at = [], node
            while at != seed:
                e = min(e for e in path if e[2] == at and e[3] in back and back[e[3]] == back[at] - 1)
                ids.append(e[0])
                at = e[3]
            for o in obs:
                tail, at = [], o
                while at != seed:
                    e = min(e for e in path if e[3] == at and e[2] in on and on[e[2]] == on[at] - 1)
                    tail.insert(0, e[0])
                    at = e[2]
                around = None if seed in (node, o) else _distances(turned, [(o, 0)], {seed}).get(node)
                found.add((seed, node, o, cs, " ".join(ids + tail), around))
                any_path = True
        if not any_path:
            frontiers.add((seed, "ENTRYPOINT_NOT_CONFIRMED"))
    return found, frontiers, bad


def test_entrypoints_equal_plain_search(spark):
    schema = "edge_id string, pos int, src string, dst string, kind string, condition string, confidence double, evidence array<string>"
    rng = random.Random(12)
    n, edges = 26, []
    for k in range(52):
        a, b = (f"n{rng.randrange(n):02}" for _ in range(2))
        edges.append((f"e{k:02}", rng.randrange(3), a, b, rng.choice(["calls", "data_flow", "exports", "field_flow", "triggers"]), rng.choice(CONDITIONS)))
    edges += [(f"r{i}", 0, f"ring{i}", f"ring{(i + 1) % 3}", "calls", None) for i in range(3)]  # nothing leads there
    nodes = {f"n{i:02}": i % 5 == 0 for i in range(n)} | {f"ring{i}": False for i in range(3)}
    seeds, observations = [f"n{i:02}" for i in range(1, 16)] + ["lost"], ["n03", "n17", "n22"]
    e = spark.createDataFrame([(*x, 0.5, [x[4]]) for x in edges] + [("dead", 0, None, "n01", "calls", None, 0.5, None)], schema)
    nd = spark.createDataFrame([*nodes.items(), (None, True)], "node string, controllable boolean")
    sd = spark.createDataFrame([(s,) for s in [*seeds, None]], "node string")
    ob = spark.createDataFrame([(o,) for o in observations], "node string")
    want, frontiers, bad = _plain_entrypoints(edges, nodes, seeds, observations, 10**6)
    got = ep.recover_entrypoints(e, nd, sd, ob)
    rows = got.paths.collect()
    assert {(r.seed, r.entry, r.observation, tuple(r.conditions), " ".join(r.edges), r.bypass) for r in rows} == want and len(rows) == len(want) > 20
    assert any(r[5] is not None for r in want) and any(len(r[3]) > 1 for r in want)
    assert {tuple(r) for r in got.frontiers.collect()} == frontiers
    assert {r.node for r in got.infeasible.collect()} == bad
    kinds = {x[0]: x[4] for x in edges}
    assert all(abs(r.confidence - 0.5 ** len(r.edges)) < 1e-12 and set(r.evidence) == {kinds[i] for i in r.edges} for r in rows)
    least = {(r.seed, r.entry, r.observation, tuple(r.conditions)) for r in ep.least_conditions(got.paths).collect()}
    sets = {x[:4] for x in want}
    assert least == {x for x in sets if not any(y[:3] == x[:3] and set(y[3]) < set(x[3]) for y in sets)}
    capped = ep.recover_entrypoints(e, nd, sd, ob, states=3).frontiers.where("kind = 'ENTRYPOINT_SLICE_CAP'")
    _, named, _ = _plain_entrypoints(edges, nodes, seeds, observations, 3)
    assert {r.seed for r in capped.collect()} == {s for s, k in named if k == "ENTRYPOINT_SLICE_CAP"}


def _reach(pairs, v):
    return set(_distances(pairs, [(v, 0)]))


def test_reach_sizes(spark):
    rng = random.Random(1)
    pairs = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(70)] + [(str(100 + i), str(101 + i)) for i in range(40)] + [("140", "5"), ("7", "100"), ("8", "8")]
    names = {x for p in pairs for x in p} | {"alone"}
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    got = cuts.reach_sizes(spark.createDataFrame([*pairs, ("1", None)], "src string, dst string"), nodes, F.col("node") != "5")
    assert {r.node: r.reach for r in got.collect()} == {v: len(_reach(pairs, v) - {"5"}) for v in names}


def test_reach_estimates_above_the_sketch(spark):
    """Past 2^7 nodes counts are estimates; at the real size everything up to 1000 is exact."""
    wide = [("top", f"m{i:04}") for i in range(3000)] + [("root", "top")]
    edges = spark.createDataFrame(wide, "src string, dst string")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    small = {r.node: r.reach for r in cuts.reach_sizes(edges, nodes, bits=7).collect()}
    assert abs(small["root"] - 3002) < 0.35 * 3002 and small["m0007"] == 1
    real = {r.node: r.reach for r in cuts.reach_sizes(edges, nodes).where("node in ('root', 'top')").collect()}
    assert all(abs(v - 3002) < 0.12 * 3002 and v > 1000 for v in real.values())


def test_best_cover_equals_greedy(spark):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(50):02}", f"u{rng.randrange(150):03}") for _ in range(400)})
    scores = {f"n{i:02}": float(rng.randrange(4)) for i in range(50)}
    left = defaultdict(set)
    for n, u in pairs:
        left[n].add(u)
    want = []
    while any(left.values()):
        n = max(left, key=lambda n: (len(left[n]), scores[n], n))
        want.append((len(want) + 1, n, len(left[n])))
        left = {m: u - left[n] for m, u in left.items()}
    got = cuts.best_cover(spark.createDataFrame([*pairs, (None, "u000")], "node string, unit string"), spark.createDataFrame(list(scores.items()), "node string, score double"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_repair_cut(spark):
    kinds = ["calls", "data_flow", "exports", "control_flow"]
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(24):02}", f"n{rng.randrange(24):02}") for _ in range(40)]
    edges = [(f"e{i}", rng.choice(kinds), a, b) for i, (a, b) in enumerate(pairs)] + [("t1", "test_coverage", "n03", "test1"), ("t2", "test_coverage", "test1", "test2")]
    legal = {f"n{i:02}": i % 4 != 1 for i in range(24)}
    nodes = [(n, "statement", ok, False) for n, ok in legal.items()] + [("test1", "test", False, True), ("test2", "test", False, True)]
    entries, seen = ["n00", "n01", "n02"], ["n20", "n21"]
    units = [(f"u{i % 6}", f"n{i:02}") for i in range(24)] + [("far", "n99")]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    ranked, roles = cuts.causal_repair_cut(df(edges, "edge_id string, kind string, src string, dst string"), df(nodes, "node string, kind string, legal boolean, is_test boolean"), df([(x,) for x in entries], "node string"), df([(x,) for x in seen], "node string"), df(units, "unit string, node string"))
    on = [(a, b) for _, k, a, b in edges if k in cuts.FORWARD]
    back = [(b, a) for _, k, a, b in edges if k in cuts.BACKWARD]
    between = set(_distances(on, [(x, 0) for x in entries])) & set(_distances(back, [(x, 0) for x in seen]))
    fair = {n for n in between if legal[n]}
    far = _distances([(b, a) for a, b in on], [(x, 0) for x in seen])
    rows = {}
    for n in fair:
        mine = {u for u, m in units if m == n}
        tests = len(_reach([(a, b) for _, k, a, b in edges if k == "test_coverage"], n) & {"test1", "test2"})
        rows[n] = (len(mine), far.get(n, 1000), len(_reach(on, n)), tests, round(len(mine) * 10.0 - far.get(n, 1000) - 0.05 * len(_reach(on, n)) - 3.0 * tests, 6))
    order = sorted(fair, key=lambda n: (-rows[n][4], n))
    assert [(r.node, r.covered, r.distance, r.blast, r.conflicts, r.score) for r in ranked.orderBy("rank").collect()] == [(n, *rows[n]) for n in order] and len(fair) > 3
    open_, picked = {u for u, _ in units}, []
    while True:
        gain = {n: {u for u, m in units if m == n} & open_ for n in fair}
        best = max((n for n in fair if gain[n]), key=lambda n: (len(gain[n]), rows[n][4], n), default=None)
        if best is None:
            break
        picked.append(best)
        open_ -= gain[best]
    got = defaultdict(set)
    for r in roles.collect():
        got[r.role].add(r.id)
    assert got["selected"] == set(picked) and got["uncovered"] == open_ and got["covered"] == {u for u, _ in units} - open_
    assert got["excluded"] == between - fair
    assert got["boundary"] == {a for _, k, a, b in edges if k in cuts.INSERTIONS and b in picked and legal.get(a)}
    assert got["impact"] >= got["selected"]
    none, roles = cuts.causal_repair_cut(df(edges, "edge_id string, kind string, src string, dst string"), df(nodes, "node string, kind string, legal boolean, is_test boolean"), df([], "node string"), df([(x,) for x in seen], "node string"))
    assert none.collect() == [] and roles.where("role = 'selected'").collect() == []


def test_maintained_distances_equal_new_ones(spark):
    """Random edits, one after another, with cycles, parallel searches and edits that change nothing."""
    rng = random.Random(7)
    pairs = set(_graph(rng, 30, 55))
    sources = ["n00", "n07", "n13"]
    want = lambda: {(s, n): d for s in sources for n, d in _distances(sorted(pairs), [(s, 0)]).items()}
    schema = "search string, node string, distance long"
    stored = spark.createDataFrame([(*k, d) for k, d in want().items()], schema)
    for _ in range(3):
        before = want()
        gone = set(rng.sample(sorted(pairs), 9))
        come = set(_graph(rng, 30, 7)) - gone
        pairs = (pairs - gone) | come
        df = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string")
        stored, changes = inc.maintain(df(pairs), stored, df(come | {("zz", "yy")}), df(gone | {("yy", "zz")} | come))
        now = want()
        assert {(r.search, r.node): r.distance for r in stored.collect()} == now
        assert {(r.search, r.node, r.was, r.now) for r in changes.collect()} == {(*k, before.get(k), now.get(k)) for k in before.keys() | now.keys() if before.get(k) != now.get(k)}


def test_merge_slice(spark):
    nodes = lambda rows: spark.createDataFrame(rows, "node string, file string, body int")
    edges = lambda rows: spark.createDataFrame([(i, [a], [b], "") for i, a, b in rows], "edge_id string, source_ids array<string>, target_ids array<string>, body string")
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    old = nodes([("a", "f", 1), ("b", "f", 1), ("c", "g", 1), ("d", None, 1), ("e", "h", 1)])
    was = edges([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d"), ("4", "d", "e")])
    new = nodes([("b", "f", 2), ("x", "f", 1), ("y", "q", 1)])
    got = inc.merge_slice(old, was, new, edges([("5", "x", "c"), ("6", "y", "c"), ("3", "x", "x")]), files("f", "g"), files(), files(), 10, 10)
    assert {r.node for r in got.nodes.collect()} == {"b", "c", "d", "x"} and {r.edge_id for r in got.edges.collect()} == {"3", "5"}
    assert {tuple(r) for r in got.changes.collect()} == {("node", "a", "removed"), ("node", "b", "modified"), ("node", "e", "removed"), ("node", "x", "added"), ("edge", "1", "removed"), ("edge", "2", "removed"), ("edge", "4", "removed"), ("edge", "5", "added")}
    assert got.truncated.collect() == []
    less = inc.merge_slice(old, was, new, edges([("5", "x", "c")]), files("f", "g"), files(), files("z"), 3, 1)
    assert {r.node for r in less.nodes.collect()} == {"b", "c", "d"} and {r.edge_id for r in less.edges.collect()} == {"3"}
    assert {r.reason for r in less.truncated.collect()} == {"NODE_LIMIT", "DEFERRED_FILES"}


def test_frames_and_cuts_with_odd_rows(spark):
    nodes = spark.createDataFrame([("a", "return", "M.Run", "f.py", 3, None), ("b", "call", "x", "f.py", 1, 500), ("c", "call", "x", None, 1, 2), ("d", "call", "x", "tests/t.py", 1, 2), ("e", "call", "x", "f.py", 9, 2)], "node string, kind string, symbol string, file string, line int, end_line int")
    frames = spark.createDataFrame([(1, 0, "f.py", 3), (1, 1, "f.py", 400), (2, 0, "g.py", 1), (3, 0, None, 1)], "search int, place int, file string, line int")
    assert {tuple(r) for r in search.frame_nodes(frames, nodes).collect()} == {(1, 0, "a"), (1, 0, "b"), (1, 1, "b")}
    edges = spark.createDataFrame([("calls", "b", "a"), ("raises", "d", "a"), ("calls", "c", "b")], "kind string, src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (2, "zz")], "search int, node string")
    words = spark.createDataFrame([(1, "run")], "search int, word string")
    got = search.ranked_cuts(edges, nodes, starts, words, words.select("search", F.lit("f.py").alias("file")), F.col("file").startswith("tests/"))
    assert [(r.place, r.node, r.distance, r.reasons.count(";")) for r in got.orderBy("place").collect()] == [(1, "a", 0, 2), (2, "b", 1, 1)]
    assert list(itertools.chain(*[x.collect() for x in search.causal_slices(edges.withColumn("edge_id", F.lit("e")).limit(0), nodes.withColumn("predicate", F.lit(None).cast("boolean")).limit(0), starts.withColumn("distance", F.lit(0)))])) == []
