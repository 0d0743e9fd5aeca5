"""Findings of a run over larger tables: each case is small, and failed before."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from basalt.operators import bindings, cuts, entrypoints, graph, ledger
from basalt.operators.store import Rounds
from basalt.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """The tables at the smallest scale, some of them written anew: folder(customer="SELECT ...")."""
    import os

    def make(**tables):
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
        for f in os.listdir(SF):
            name = f[:-8]
            if name in tables:
                con.execute(f"COPY ({tables[name]}) TO '{tmp_path}/{f}' (FORMAT parquet)")
            else:
                os.symlink(f"{SF}/{f}", tmp_path / f)
        return str(tmp_path)

    return make


def expected(sf_dir, name):
    import glob

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    answer = con.execute(registry.oracle_sql()[name])
    return [c[0] for c in answer.description], answer.fetchall()


def same(spark, sf_dir, name):
    columns, rows = expected(sf_dir, name)
    got = registry.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_balance_of_minus_zero(spark, folder):
    same(spark, folder(customer="SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN CAST('-0.0' AS DOUBLE) ELSE c_acctbal END AS c_acctbal) FROM customer"), "canonical_json")


def _greedy(covers, key):
    left, picks = {n: set(us) for n, us in covers.items()}, []
    while any(left.values()):
        best = max((n for n in left if left[n]), key=lambda n: key(n, len(left[n])))
        taken = left[best]
        picks.append((best, len(taken)))
        left = {n: us - taken for n, us in left.items()}
    return picks


def _counted_rounds(monkeypatch):
    n, put = [0], Rounds.put
    monkeypatch.setattr(Rounds, "put", lambda self, df: n.__setitem__(0, n[0] + 1) or put(self, df))
    return n


@pytest.mark.parametrize("task_edges", [2_000_000, 60, 5])
def test_cover_takes_few_rounds(spark, monkeypatch, task_edges):
    """Nodes that all share units were picked one a round."""
    rng = random.Random(7)
    covers = {f"n{i}": {rng.randrange(150) for _ in range(rng.choice([3, 9, 12]))} for i in range(40)}
    cost = {n: rng.choice([0.5, 1.0, 3.0]) for n in covers}
    number = {n: -int(n[1:]) for n in covers}  # equal gains: text order decides
    rows = spark.createDataFrame([(n, f"u{u}") for n, us in covers.items() for u in us], "node string, unit string")
    costs = spark.createDataFrame(list(cost.items()), "node string, cost double")
    score = {n: float(abs(number[n]) % 3) for n in covers}
    scores = spark.createDataFrame(list(score.items()), "node string, score double")
    order = sorted(covers, reverse=True)
    n = _counted_rounds(monkeypatch)
    batches = graph.picked_in_batches
    limited = lambda *a, **k: batches(*a, **k, task_edges=task_edges)
    monkeypatch.setattr(graph, "picked_in_batches", limited)
    monkeypatch.setattr(cuts, "picked_in_batches", limited)
    got = sorted(graph.set_cover(rows, costs).collect())
    assert [(r["node"], r["gain"]) for r in got] == _greedy(covers, lambda x, g: (g / cost[x], g, order.index(x)))
    got = sorted(cuts.best_cover(rows, scores).collect())
    assert [(r["node"], r["gain"]) for r in got] == _greedy(covers, lambda x, g: (g, score[x], x))
    assert task_edges < 1000 or n[0] <= 14


def test_hunks_are_not_made_unique_as_pairs(spark):
    """All pairs went through a shuffle of their own; only a hunk of several files can meet a unit twice."""
    from basalt.operators import bindings as bd

    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    symbols = df([(1, "a", "x.f"), (1, "b", "x.g"), (1, "a", "x.f"), (2, "b", "y.f"), (None, "a", "z"), (3, None, "pkg.m.f")], "unit long, file string, name string")
    relations = df([("c", "m.f"), ("c", "m.f"), (None, "f")], "file string, scope string")
    hunks = df([(10, "a"), (10, "b"), (10, "b"), (11, "a"), (11, "a"), (12, "c"), (13, None), (None, "b"), (12, None)], "hunk long, file string")
    out = bd.hunks_for_symbols(symbols, relations, hunks)
    want = {(1, 10), (1, 11), (1, None), (2, 10), (2, None), (None, 10), (None, 11), (3, 12)}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")  # and the first part is a join that nothing follows


def test_pairs_of_single_columns_are_laid_out_from_plain_values(spark):
    """Each value was a struct of one field in its block, and was unpacked for every pair."""
    from basalt.operators.pairs import met

    left = spark.createDataFrame([(1, "a"), (None, "a"), (2, "b"), (3, None)], "unit long, file string")
    right = spark.createDataFrame([("x", "a"), (None, "a"), ("y", "b"), ("z", None)], "hunk string, file string")
    out = met(left, right, ["file"], Rounds(spark, "plain"), block=1)
    assert out.columns == ["unit", "hunk"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "x"), (1, None), (None, "x"), (None, None), (2, "y")], key=str)
    assert "array<struct" not in out._jdf.queryExecution().executedPlan().toString()
    wide = met(left, right.withColumn("n", F.length("file")), ["file"], Rounds(spark, "plain"))
    assert wide.columns == ["unit", "hunk", "n"] and wide.where("n = 1").count() == 5


def _pairs_leave_unshuffled(df):
    """No exchange, sort or aggregate stands above the explosion that makes the pairs."""
    top = df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    return "Generate" in df._jdf.queryExecution().optimizedPlan().toString() and not any(x in top for x in ("Aggregate", "Sort", "Window", "Join", "Repartition"))


def test_candidate_units_leave_unshuffled(spark):
    from basalt.operators import bindings as bd

    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert _pairs_leave_unshuffled(registry.queries()["candidate_units"](spark, SF))
    relations = df([(1, "a", "<module>"), (1, "b", "f"), (2, "b", "g"), (3, "a", "f"), (3, "a", "f"), (4, None, "f"), (5, "b", None), (None, "a", "f")], "relation long, file string, scope string")
    changed = df([("n1", "a", "x.f"), ("n2", "b", "x.f"), ("n3", "a", "x.f")], "node string, file string, name string")
    units = df([(7, "n1"), (7, "n2"), (7, "n3"), (8, "n2"), (9, "n4"), (None, "n1")], "unit long, node string")
    direct, rest, every = bd.candidate_units(relations, changed, units)
    assert sorted(map(tuple, direct.collect()), key=str) == sorted([(1, 7), (1, 8), (1, None), (3, 7), (3, None), (None, 7), (None, None)], key=str)
    assert {r[0] for r in rest.collect()} == {2, 4, 5, None} and {r[0] for r in every.collect()} == {7, 8, None}


def test_polarity_pairs_leave_unshuffled(spark, folder):
    """All pairs of a table in one file were one task's work; ids that repeat or are null stay rows of their own."""
    keys = "CASE WHEN p_partkey < 60 THEN p_partkey % 20 WHEN p_partkey = 71 THEN NULL ELSE p_partkey END"
    d = folder(part=f"SELECT * REPLACE ({keys} AS p_partkey, p_size % 3 AS p_size) FROM '{SF}/part.parquet'")
    same(spark, d, "polarity_conflicts")
    assert _pairs_leave_unshuffled(registry.queries()["polarity_conflicts"](spark, d))


def test_check_pairs_leave_unshuffled(spark):
    from basalt.operators import bindings as bd

    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    reqs = df([("r1", ["e1", "e2"], ["p.A.f"]), ("r1", ["e3"], []), ("r2", None, ["q.f", None]), ("r3", ["e9"], None)], "requirement string, evidence array<string>, symbols array<string>")
    rows = [(1, "TARGET", ["r1", "r1"], ["e1", "e2"], "r1", []), (2, "X", [], ["e2", None], "", ["A.f"]), (3, "PRESERVATION", ["r3"], [], "r3", ["f", ""]), (4, "TARGET", None, ["e1", "e2"], None, []), (4, "Y", ["r2"], ["e9"], None, None), (5, "TARGET", ["none"], ["e0"], "r0", ["g"])]
    checks = df(rows, "check_id long, role string, requirements array<string>, evidence array<string>, oracle string, symbols array<string>")
    out = bd.check_projection(reqs, checks)
    want = [("r1", 1, "TARGET"), ("r1", 2, "CHALLENGE"), ("r2", 2, "CHALLENGE"), ("r1", 3, "PRESERVATION"), ("r2", 3, "PRESERVATION"), ("r3", 3, "PRESERVATION")]
    want += [(r, 4, role) for r in ("r1", "r2", "r3") for role in ("TARGET", "CHALLENGE")]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Generate" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan.split("Generate")[0]


def test_searches_that_start_alike_are_one(spark):
    """Each search was carried by itself, from all of its starts."""
    from basalt.operators import search as se

    rng = random.Random(3)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes = df([(f"m{i:03}", f"f{i % 3}", 1 + i % 5, None if i % 4 else 2 + i % 5) for i in range(60)], "node string, file string, line int, end_line int").selectExpr("*", "'call' as kind", "'M.run' as symbol", "false as predicate")
    edges = df([(f"e{i}", rng.choice(["calls", "dispatch"]), f"m{rng.randrange(60):03}", f"m{rng.randrange(60):03}") for i in range(80)], "edge_id string, kind string, src string, dst string")
    frames = df([(s, p, f"f{(s // 4 + p) % 4}", 1 + (s % 2 + 2 * p) % 6) for s in range(40) for p in range(3)] + [(50, 0, None, 1), (None, 0, "f1", 1)], "search int, place int, file string, line int")
    starts = se.frame_nodes(frames, nodes).selectExpr("search", "node", "place as distance")
    for most in (3, 12, 100):
        member, few = se.alike(frames, nodes, most)
        likes = member.select("like").distinct().count()
        assert likes < 30 and few.count() <= likes * (most + 1)
        want, got = se.causal_slices(edges, nodes, starts, most), se.causal_slices(edges, nodes, few, most)
        for a, b in zip(want, got, strict=True):
            assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, se.of_members(b, member).select(*a.columns).collect()), key=str)


def test_repair_cuts_leave_out_what_entries_cannot_reach(spark, monkeypatch):
    """The reach of every node was counted, also of those that no entry leads to."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = df([(f"e{i}", "calls", f"x{i}", f"x{i + 1}") for i in range(20)] + [("a", "calls", "in", "m"), ("b", "triggers", "m", "out"), ("c", "calls", "x3", "m"), ("d", "test_coverage", "m", "t")], "edge_id string, kind string, src string, dst string")
    nodes = df([(n, n == "m", n == "t") for n in ["in", "m", "out", "t", *[f"x{i}" for i in range(21)]]], "node string, legal boolean, is_test boolean")
    counted, sizes = [], cuts.reach_sizes
    monkeypatch.setattr(cuts, "reach_sizes", lambda e, n, *a: counted.append(n.count()) or sizes(e, n, *a))
    got = cuts.ranked_nodes(edges, nodes, df([("in",)], "node string"), df([("out",)], "node string")).ranked.collect()
    assert [(r["node"], r["covered"], r["distance"], r["blast"], r["conflicts"]) for r in got] == [("m", 1, 1000, 1, 1)]
    assert max(counted) <= 3


def test_ledger_searches_only_what_leaves_a_path(spark, monkeypatch):
    """Each observation was searched back to all that leads to it, also past every edge that leaves a path."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = df([("e0", "calls", "a", "m"), ("e1", "calls", "m", "z"), ("e2", "calls", "a", "b"), ("e3", "calls", "b", "z"), ("e4", "calls", "a", "dead"), *[(f"x{i}", "calls", f"x{i}", "z") for i in range(30)]], "edge_id string, kind string, src string, dst string").selectExpr("*", "cast(null as string) as condition")
    paths = df([("l", "p", "w", ["a", "m", "z"], ["e0", "e1"], ["z"])], "leaf string, partition string, path string, nodes array<string>, edges array<string>, observations array<string>")
    seen, search = [], ledger.spread
    monkeypatch.setattr(ledger, "spread", lambda *a, **k: seen.append(search(*a, **k)) or seen[-1])
    got = ledger.edge_ledger(paths, edges, df([("m", "call")], "node string, kind string"), df([("p", [])], "partition string, constraints array<string>")).collect()
    assert sorted((r["node"], r["edge_id"], r["status"]) for r in got) == [("a", "e0", "ENUMERATED"), ("a", "e2", "FRONTIER"), ("m", "e1", "ENUMERATED")]
    assert sum(visited.count() for visited, _ in seen) <= 4


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffle files stayed until the driver's garbage was collected."""
    import glob
    import os

    kept = lambda: {f for f in glob.glob(f"{spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]}/*/shuffle_*") if os.path.getsize(f)}
    was = kept()
    table = Rounds(spark, "kept").put(spark.range(1000).groupBy((F.col("id") % 300).alias("k")).count())
    left = [f for f in kept() - was if f.endswith(".data")]
    assert not left and table.count() == 300
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") != "true"


def test_paths_of_units_are_no_shuffled_pairs(spark, monkeypatch):
    """Every pair of a unit and a path was shuffled, also of a node with many paths."""
    monkeypatch.setattr(bindings, "LISTS", 2)
    rng = random.Random(4)
    units = [(u, rng.randrange(8)) for u in range(12) for _ in range(5)] + [(99, n) for n in range(9)] + [(None, 1), (3, None)]
    paths = [(p, rng.randrange(8)) for p in range(60)] + [(p, 0) for p in range(100, 200)] + [(None, 2), (7, None), (7, 0), (7, 0)]
    got = bindings.path_projection(spark.createDataFrame(units, "unit int, node int"), spark.createDataFrame(paths, "path int, node int"), 15)
    want = set()
    for u in {u for u, _ in units}:
        held = {p for p, n in paths if n is not None and (u, n) in units}
        want |= {(u, p, k + 1) for k, p in enumerate(sorted(held, key=lambda p: (p is not None, p or 0))[:15])}
    rows = [tuple(r) for r in got.select("unit", "path", "place").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert not re.search(r"hashpartitioning\(unit#\d+, path#", got._jdf.queryExecution().executedPlan().toString())


def test_bypasses_follow_only_what_a_seed_cuts_off(spark, monkeypatch):
    """Each seed and observation had a search of its own, over all that leads to the observation."""
    sizes, put = [], Rounds.put
    monkeypatch.setattr(Rounds, "put", lambda self, df: (sizes.append((out := put(self, df)).count()), out)[1])
    n = 60
    pairs = [("top", f"c{i}") for i in range(n)] + [(f"c{i}", f"o{i}") for i in range(n)] + [(f"o{i}", "p") for i in range(n)]
    pairs += [("c0", "x1"), ("x1", "x2"), ("x2", "p"), ("c1", "c0"), ("o2", "q")]  # a longer way round o0 and o1; q has none
    ways = spark.createDataFrame([(*p, 1) for p in pairs], "src string, dst string, length long")
    around = spark.createDataFrame([(f"o{i}", "p") for i in range(n)] + [("o2", "q")], "seed string, observation string")
    wanted = around.selectExpr("seed", "concat('c', substring(seed, 2)) AS entry", "observation").unionByName(around.selectExpr("seed", "'top' AS entry", "observation"))
    got = {(r.seed, r.entry, r.observation): r.bypass for r in entrypoints.bypasses(ways, around, wanted, Rounds(spark, "test")).collect()}
    assert got == {("o0", "c0", "p"): 3, ("o1", "c1", "p"): 3} | {(f"o{i}", "top", "p"): 3 for i in range(n)}
    assert max(sizes) < 4 * n  # the searches took n * 3 * n rows


def test_reach_keeps_few_tables(spark, monkeypatch, tmp_path):
    """All edges were laid down five times, and no table went before the session did."""
    from basalt.operators import store

    monkeypatch.setattr(store, "folder", lambda spark: str(tmp_path))
    sizes, put = [], Rounds.put
    monkeypatch.setattr(Rounds, "put", lambda self, df: (sizes.append((out := put(self, df)).count()), out)[1])
    pairs = [(f"a{i}", f"b{j}") for i in range(6) for j in range(10)] + [("r", f"a{i}") for i in range(6)] + [("b0", "x"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame(pairs + pairs[:5] + [("r", "r"), ("r", None)], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in {n for p in pairs for n in p} - {"b9"}], "node string")
    got = {r.node: r.reach for r in cuts.reach_sizes(edges, nodes).collect()}
    assert got == {"r": 18, "x": 2, "y": 2, "b0": 3, "b9": 0} | {f"a{i}": 12 for i in range(6)} | {f"b{j}": 1 for j in range(1, 9)}
    assert sum(n >= 60 for n in sizes) <= 3  # the edges, these between components, and what is left of them
    assert len([t for t in tmp_path.glob("*/*") if t.is_dir()]) == 1


def test_entrypoints_lay_edges_down_once(spark, monkeypatch):
    """Edges and the ways between were written for each search, and bypasses took two more tables of them."""
    tables, put = [], Rounds.put
    monkeypatch.setattr(Rounds, "put", lambda self, df: (tables.append(set(df.columns)), put(self, df))[1])
    pairs = [(f"c{i}", f"o{j}") for i in range(8) for j in range(12)] + [(f"o{j}", f"p{j % 2}") for j in range(12)]
    edges = spark.createDataFrame([(f"{a}>{b}", 0, a, b, "calls", None, 1.0, ["x"]) for a, b in pairs], "edge_id string, pos int, src string, dst string, kind string, condition string, confidence double, evidence array<string>")
    node = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    nodes = node({n for p in pairs for n in p}).withColumn("controllable", F.col("node").startswith("c"))
    got = entrypoints.recover_entrypoints(edges, nodes, node(f"o{j}" for j in range(12)), node(["p0", "p1"]))
    rows = got.paths.collect()
    assert {(r.seed, r.entry, r.observation, r.bypass) for r in rows} == {(f"o{j}", f"c{i}", f"p{j % 2}", 2) for i in range(8) for j in range(12)} and len(rows) == 96
    assert sum("edge_id" in t for t in tables) == 2  # all edges, and those that lead on
    assert sum(t == {"src", "dst", "length"} for t in tables) == 1


def test_reach_reads_edges_to_ends_once(spark, monkeypatch):
    """Edges to nodes that lead nowhere were searched for cycles, waited for their ends and were joined in rounds."""
    left, put = [], Rounds.put

    def counted(self, df):
        out = put(self, df)
        if {"src", "dst"} < set(df.columns) or self.root.rsplit("/", 1)[-1].startswith("scc"):
            left.append(out.count())
        return out

    pairs = [(f"a{i}", f"b{j}") for i in range(6) for j in range(10)] + [("r", f"a{i}") for i in range(6)] + [("q", "a1"), ("q", "b1"), ("b3", "b3")]
    edges = spark.createDataFrame(pairs + pairs[:5], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in {n for p in pairs for n in p} - {"b9"}], "node string")
    monkeypatch.setattr(Rounds, "put", counted)
    got = {r.node: r.reach for r in cuts.reach_sizes(edges, nodes, F.col("node") != "b2").collect()}
    assert got == {"r": 15, "q": 10, "b2": 0, "b9": 0} | {f"a{i}": 9 for i in range(6)} | {f"b{j}": 1 for j in (0, 1, 3, 4, 5, 6, 7, 8)}
    assert sorted(left)[-1] > 50 and sorted(left)[-2] <= 8  # only the table that tells edges apart holds them all
