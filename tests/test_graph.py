import random

from basalt.operators import decisions as d
from basalt.operators import graph as g


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_small_graph(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in g.reachable(e, start).collect()} == set("abcd")
    assert {(r.node, r.hops) for r in g.hops(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in g.reachable(e, start, forbidden=["c"]).collect()} == {"a", "b"}
    assert {r.node: r.component for r in g.strong_components(e).collect()} == {"a": "a", "b": "b", "c": "b", "d": "d"}


def test_chain_has_only_single_components(spark):
    e = _edges(spark, [(f"{i:05}", f"{i + 1:05}") for i in range(2499)])
    got = g.strong_components(e)
    assert got.count() == 2500 and got.where("size > 1").count() == 0


def test_distributed_components_equal_local(spark):
    rng = random.Random(5)
    pairs = [(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(40)]
    one = {tuple(r) for r in g.strong_components(_edges(spark, pairs)).collect()}
    many = {tuple(r) for r in g.strong_components(_edges(spark, pairs), task_edges=4).collect()}
    assert one == many


def test_hyperedges_are_full_products(spark):
    h = spark.createDataFrame([("e", ["a", "b"], ["c", "d"])], "edge_id string, source_ids array<string>, target_ids array<string>")
    assert {(r.src, r.dst) for r in g.hyperedge_pairs(h, ["edge_id"]).collect()} == {(s, t) for s in "ab" for t in "cd"}


def test_empty_edges(spark):
    e = _edges(spark, [])
    assert g.connected_components(e).count() == 0
    assert g.strong_components(e).count() == 0


def test_set_cover_equals_greedy(spark):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(120):03}", f"u{rng.randrange(400):03}") for _ in range(900)] + [(f"z{i:02}", f"own{i}") for i in range(60)]
    left, want = {}, []
    for node, unit in pairs:
        left.setdefault(node, set()).add(unit)
    while any(left.values()):
        node = min(left, key=lambda n: (-len(left[n]), n))
        want.append((len(want) + 1, node, len(left[node])))
        left = {n: u - left[node] for n, u in left.items()}
    assert len(want) > 50
    covers = spark.createDataFrame([*pairs, ("n000", None), (None, "u000")], "node string, unit string")
    assert sorted(tuple(r) for r in g.set_cover(covers).collect()) == want
    assert sorted(tuple(r) for r in g.set_cover(covers, most=3).collect()) == want[:3]


CASES = [
    ("TARGET", "FAIL", "PASS", True, "TARGET_FIXED"), ("TARGET", "FAIL", "FAIL", True, "TARGET_STILL_FAILING"),
    ("TARGET", "PASS", "FAIL", True, "TARGET_REGRESSED"), ("TARGET", "PASS", "PASS", True, "PASS_PRESERVED"),
    ("PRESERVATION", "PASS", "FAIL", True, "PRESERVATION_REGRESSION"), ("PRESERVATION", "FAIL", "PASS", True, "TARGET_FIXED"),
    ("EXPLORATION", "PASS", "FAIL", True, "TARGET_REGRESSED"), ("TARGET", "INVALID_ENVIRONMENT", "PASS", True, "SAME_INFRA_FAILURE"),
    ("TARGET", "PASS", "INVALID_SELECTOR", True, "NEW_INFRA_FAILURE"), ("TARGET", "INVALID_SELECTOR", "PASS", True, "UNSUPPORTED_CHECK"),
    ("TARGET", "PASS", "UNSUPPORTED", True, "UNSUPPORTED_CHECK"), ("TARGET", "PASS", "FAIL", False, "FLAKY_RESULT"), ("TARGET", "PASS", "TIMEOUT", True, "FLAKY_RESULT"),
]


def test_classes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(CASES, "role string, b string, p string, stable boolean, want string")
    got = rows.select("want", d.classify_check_pair(F.col("b"), F.col("p"), F.col("stable"), F.col("stable"), F.col("role")).alias("got"))
    assert all(r.want == r.got for r in got.collect())
