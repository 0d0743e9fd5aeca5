"""Greedy admission and budget ledgers against plain loops."""

import random

from basalt.operators import slices as sl


def test_admission_passes_over_what_does_not_fit(spark):
    rng = random.Random(5)
    rows = [(s, i, f"f{i}", rng.randrange(1, 40), rng.randrange(60), rng.randrange(5)) for s in range(6) for i in range(25)]
    limits = {"files": 8, "nodes": 120, "edges": 200, "functions": 14}
    want = {}
    for s in range(6):
        used = [0, 0, 0, 0]
        for _, _, f, *cost in [r for r in rows if r[0] == s]:
            new = [u + c for u, c in zip(used, [1, *cost], strict=True)]
            want[s, f] = all(n <= m for n, m in zip(new, limits.values(), strict=True))
            used = new if want[s, f] else used
    got = sl.admit_files(spark.createDataFrame(rows, "slice int, place int, file string, nodes int, edges int, functions int"), limits)
    assert {(r.slice, r.file): r.admitted for r in got.collect()} == want


def test_ledger(spark):
    ledgers = spark.createDataFrame([("l", 100.0, 10.0)], "ledger string, tokens double, other double")
    charges = [("l", 1, "a", "graph", 0.0, 4.0), ("l", 2, "a", "graph", 0.0, 1.0), ("l", 3, "b", "nobody", 0.0, 1.0), ("l", 4, "c", "repair-generator", 40.0, 0.0), ("l", 5, "d", "graph", 0.0, 1.0), ("l", 6, "e", "initial-generator", 61.0, 0.0), ("l", 7, "f", "initial-generator", 60.0, 6.0)]
    got = sl.charge(ledgers, spark.createDataFrame(charges, "ledger string, seq int, request string, role string, tokens double, other double")).collect()
    assert [(r.request, r.verdict, r.tokens_left, r.other_left) for r in got] == [("a", "CHARGED", 100.0, 6.0), ("a", "DUPLICATE", 100.0, 6.0), ("b", "UNKNOWN_ROLE", 100.0, 6.0), ("c", "CHARGED", 60.0, 6.0), ("d", "RESERVE", 60.0, 6.0), ("e", "EXHAUSTED", 60.0, 6.0), ("f", "CHARGED", 0.0, 0.0)]


def test_assignments_equal_all_readings(spark):
    import itertools

    from basalt.operators.solve import WORTH, enumerate_assignments

    rng = random.Random(9)
    claims, refutes = [], []
    for g in range(6):
        names = [f"g{g}c{i}" for i in range(7)]
        for i, c in enumerate(names):
            claims.append((g, c, "NORMATIVE_REQUIREMENT" if i == 6 else "SEMANTIC_HYPOTHESIS", f"s{i % 3}", rng.choice(["A", "B", "PROVISIONAL"]) if i < 6 else "A", [f"k{rng.randrange(4)}"]))
        refutes += [(g, *rng.sample(names, 2)) for _ in range(4)]
    got = enumerate_assignments(spark.createDataFrame(claims, "graph int, claim string, kind string, subject string, authority string, clusters array<string>"), spark.createDataFrame(refutes, "graph int, a string, b string")).collect()
    for g in range(6):
        own = {c[1]: c for c in claims if c[0] == g}
        bad = {frozenset(r[1:]) for r in refutes if r[0] == g}
        subjects = [sorted(c for c, r in own.items() if r[2] == "SEMANTIC_HYPOTHESIS" and r[3] == s) for s in ("s0", "s1", "s2")]
        want = []
        for pick in itertools.product(*[[*s, "?"] for s in subjects]):
            held = [c for c in pick if c != "?"]
            if any(frozenset(p) in bad for p in itertools.combinations([*held, f"g{g}c6"], 2)):
                continue
            score = sum(WORTH.get(own[c][4], 0.5) for c in held) - pick.count("?") + 0.25 * len({own[c][5][0] for c in held})
            want.append((-score, pick, all(c != "?" or not any(own[x][4] in WORTH for x in s) for c, s in zip(pick, subjects, strict=True))))
        want.sort()
        mine = sorted((r.place, -r.score, tuple(r.choices), r.complete) for r in got if r.graph == g)
        assert [m[1:] for m in mine] == want[:32]
