"""Near duplicates, lines, search, shards, rules, chats and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm.balltree import BallTree, integer_vectors, top_k
from basalt.llm.chat import build_conversations
from basalt.llm.common import ship
from basalt.llm.line_dedup import dedup_lines
from basalt.llm.ngram_join import matched_depth, near_duplicates
from basalt.llm.quality import features, judge
from basalt.llm.sharding import assign, ring, settle

RNG = random.Random(7)


def _text(n):
    return " ".join(f"v{RNG.randrange(5000)}" for _ in range(n))


def _corpus():
    base = [_text(60) for _ in range(25)]
    texts = list(base)
    for b in base[:8]:
        w = b.split()
        w[RNG.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    hot = _text(80)
    texts += [hot] * 12 + [f"{hot} tail{i}" for i in range(15)] + ["", None, "one two", "one two", "a b c d e"]
    return [(i, t, "x") for i, t in enumerate(texts)]


def _sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_near_duplicates_equal_brute_force(spark):
    ship(spark)
    rows = _corpus()
    sets = _sets([t for _, t, _ in rows])
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= 0.8 * len(a | b):
                links[i].add(j)
    root = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        root[i] = min(seen)
    got = {r.doc_id: (r.class_id, r.links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, shingles string")).collect()}
    assert got == {i: (root[i], len(links[i])) for i in links}


@pytest.mark.parametrize("block", [800, 3])
def test_chains_of_near_duplicates_are_one_class(spark, monkeypatch, block):
    """Of eight texts each is linked with the next one only; a small block makes the links cross blocks."""
    from basalt.llm import ngram_join

    ship(spark)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(104 + 7 * 8)]
        rows += [(c * 8 + k, " ".join(words[k * 8 : k * 8 + 104])) for k in range(8)]
    got = {r.doc_id: (r.class_id, r.links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i - i % 8, 1 if i % 8 in (0, 7) else 2) for i in range(48)}


def test_depth_keeps_the_target():
    d = matched_depth(0.8, 24, 8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def test_line_dedup(spark):
    ship(spark)
    long = "the quick brown fox jumps over the lazy dog near the old river bank today and tomorrow again"
    rows = [(1, f"{long}\nown one\n\n", "a"), (2, f"other\n{long}!", "b"), (3, None, "c"), (4, "", "d"), (2, f"{long}\nother", "e"), (None, "own one", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {(r.doc_id, r.removed): (r.text, r.removed_, r.n_lines) for r in dedup_lines(docs).collect()}
    assert got[None, "f"][0] == "own one" and got[1, "a"][0] == f"{long}\n\n"
    assert sorted(len(got[2, k][1]) for k in "be") == [1, 2] and got[3, "c"][0] is None and got[4, "d"][0] == ""
    assert dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_one_template_equal_brute_force(spark):
    """Many clusters of two or three lines (alike by 0.82) share a template (alike by 0.75), so bands mix clusters."""
    ship(spark)
    rng = random.Random(11)
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, lines = name(300), []
    for c in range(150):
        own = template + name(14)
        lines += [own + name(34) for _ in range(2 + c % 2)]
    rng.shuffle(lines)
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    root = list(range(len(lines)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert len(set(root)) == 150
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in dedup_lines(docs).collect() if not r.removed}
    assert got == set(root)


def test_top_k_equals_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float(v) for v in x[0]])]
    vec = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 1024)
    got = {}
    for r in top_k(vec, F.col("id") % 50 == 0, 5, shard_rows=100, block_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    m = {i: np.floor(1024 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in rows if i not in (900, 901, 902)}
    assert set(got) == {i for i in m if i % 50 == 0}
    for q, found in got.items():
        want = sorted(((-int(m[q] @ v), i) for i, v in m.items() if i != q))[:5]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_ball_tree_bounds():
    x = np.random.default_rng(1).normal(size=(300, 6))
    tree, q = BallTree(x, 8), np.random.default_rng(2).normal(size=(5, 6))
    ub = tree.bounds(q)
    for n, (lo, hi, _) in enumerate(tree.nodes):
        assert ((q @ tree.sorted[lo:hi].T).max(axis=1) <= ub[:, n]).all()


def test_sharding(spark):
    rows = [(i % 50 if i < 400 else i, "t" if i % 3 else None, i) for i in range(1003)] + [(None, None, 1)]
    out = assign(spark.createDataFrame(rows, "doc_id long, text string, slot0 int"), 7, order=("doc_id", "slot0")).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(out) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_a_new_shard_moves_little():
    demand = lambda nodes, n: {a: n // len(nodes) for a in range(len(nodes))}
    nodes = ring(10, 64)
    plan = settle(nodes, demand(nodes, 100_000), 10, 1.05)
    assert sum(e - f for _, f, e, _, _ in plan) == sum(demand(nodes, 100_000).values())
    home = sum(e - f for a, f, e, s, _ in plan if nodes[a][1] == s)
    assert home > 0.8 * sum(demand(nodes, 100_000).values())


def test_quality_features(spark):
    eight = "a b c d e f g h"
    rows = [(1, f"{eight} x {eight}", "en"), (2, None, None), (3, "z " * 30, "en"), (4, "x\nx\n \ny#\n", "fr")]
    got = {r.doc_id: r for r in features(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[1]["__n_repeat_words"], got[3]["__n_repeat_words"], got[2]["__n_words"]) == (16, 30, 0)
    assert (got[4]["__n_dup_lines"], got[4]["__n_symbols"], got[4]["__word_chars"]) == (1, 1, 4)


def test_quality_without_labels_keeps(spark):
    docs = spark.createDataFrame([(1, _text(40), "en"), (2, "few words", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in judge(docs, labels).collect()} == {1: True, 2: False}


def test_quality_limits_false_rejection(spark):
    good = [(i, " ".join(RNG.choice(["alpha", "beta", "gamma", "delta"]) + str(RNG.randrange(900)) for _ in range(30)), "en") for i in range(2500)]
    bad = [(10_000 + i, " ".join(f"w{RNG.randrange(900)}###$$$" for _ in range(30)), "en") for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad)


def test_quality_judges_every_stratum(spark, monkeypatch):
    from basalt.llm import quality

    monkeypatch.setattr(quality, "MAX_STRATA", 1)
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(900)) for _ in range(30)), ("en", "fr")[i % 2]) for i in range(2600)]
    bad = [(10_000 + i, " ".join(f"w{rng.randrange(900)}###$$$" for _ in range(30)), ("en", "fr")[i % 2]) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), labels).collect() if r.kept}
    assert kept == {i for i, _, _ in good}


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there\nmy question"), (1, 1, "assistant", "> my  Question\nan answer"), (1, 2, "user", ">> my question\n> an answer\nthanks"), (2, 0, None, None), (1, 3, "user", "> hello there\n> nothing known"), (None, 5, "user", "> x")]
    got = {(r.conv_id, r.turn): r for r in build_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].body == "an answer" and got[1, 2].parent_turn == 1 and got[1, 2].n_linked == 2
    assert got[1, 3].parent_turn == 0 and (got[1, 3].n_quoted, got[1, 3].n_linked) == (2, 1) and got[2, 0].body == "" and got[None, 5].parent_turn is None


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:2]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "line_dedup", "near_dedup", "packing"]


@pytest.mark.parametrize("name", ["op6_topk", "op8_quality", "op10_chat"])
def test_sql(spark, name):
    import duckdb

    from basalt.llm import registry

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    answer = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    got = registry.queries()[name](spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, answer.fetchall()))
