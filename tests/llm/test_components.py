import random

from basalt.llm.common import Stash
from basalt.llm.components import components


def _truth(pairs):
    near, out = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for v in sorted(near):
        if v in out:
            continue
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = v
                todo += near[x]
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame([*pairs, (5, None), (None, 6), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in components(df, Stash(spark, "t")).collect()}
    assert got == _truth(pairs)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Stash(spark, "t")).count() == 0
