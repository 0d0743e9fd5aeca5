"""Runs, languages and centroids against plain loops, with nulls, ties, copies, empty tables and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from basalt.llm import langid, q11_langid, q12_centroids, q13_runs
from basalt.llm.centroids import Tree, cluster, squared
from basalt.llm.common import ship
from basalt.llm.runs import find_runs, runs_of

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # periods rise, so the least one stays
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def random_words(rng, n):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    out = []
    while len(out) < n:
        block = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))]
        out += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randint(0, len(block))]
    return out[:n]


def check_runs(texts, prime):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], dtype=np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    want, start = [], 0
    for t in texts:
        want += [(a + start, length, q) for a, length, q in plain_runs(t)]
        start += len(t)
    assert [tuple(r) for r in runs_of(ids, lengths, prime).tolist()] == want


@pytest.mark.parametrize("prime", [2_147_483_647, 7, 2])
def test_runs_equal_plain_loops(prime):
    """With a tiny prime nearly every hash is wrong, and the words themselves put it right."""
    rng = random.Random(prime)
    for _ in range(40):
        check_runs([random_words(rng, rng.choice([0, 1, 5, 6, 7, 40, 160])) for _ in range(rng.randint(1, 6))], prime)


def test_runs_do_not_cross_texts():
    check_runs([["a"] * 5, ["a"] * 6, [], ["a"] * 3, ["b", "a"] * 4], 2_147_483_647)


def test_long_text_of_one_word():
    got = runs_of(np.zeros(60_000, dtype=np.int64), np.array([60_000]))
    assert got.tolist() == [[0, 60_000, 1]]


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op13_on_the_table(spark):
    ship(spark)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in q13_runs.op13_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs)
    for i, t in docs:
        assert got[i] == plain_digest(i, t)


def test_op13_edges(spark):
    ship(spark)
    # id 13 is one of those whose words are made periodic; no-break and ideographic spaces are no blanks here
    special = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a " * 9), (4, "x y 　 z " * 8), (5, "a " * 9), (5, "a " * 9), (special, "one two three four five six seven eight nine ten"), (7, "w" * 50_000), (8, "q r " * 30_000)]
    docs = spark.createDataFrame([(*t, 1, "c") for t in texts], "doc_id long, text string, runs int, collapsed string")
    got = sorted((tuple(r) for r in q13_runs.digests(find_runs(docs, "doc_id", rewrite=q13_runs.planted)).collect()), key=str)
    want = sorted((plain_digest(i, t) for i, t in texts if i != 8), key=str)
    assert [r for r in got if r[0] != 8] == want
    assert next(r for r in got if r[0] == 8)[1:6] == (1, 0, 60_000, 2, 30_000_000)
    assert find_runs(docs.limit(0), "doc_id").collect() == []
    out = {r.doc_id: r for r in find_runs(docs.where("doc_id = 5").limit(1), "doc_id").collect()}
    assert [tuple(x) for x in out[5].runs] == [(0, 9, 1)] and out[5].collapsed == "a"


def plain_clusters(rows, start, rounds):
    c = [list(v) for v in start]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in rows]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(rows, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((i, near(v), far(v, c[near(v)])) for i, v in rows), c


@pytest.mark.parametrize("size", [3, 40, 1 << 24, 1 << 28])
def test_clusters_equal_plain_loops(spark, size):
    """Few values make ties and copies; large ones leave the doubles, then int64."""
    ship(spark)
    rng = random.Random(size)
    rows = [(i, [rng.randint(-size, size) for _ in range(3)]) for i in range(180)] + [(i % 7, [1, -1, 0]) for i in range(120)]
    start = [rows[0][1], rows[0][1], rows[3][1], rows[8][1], rows[200][1]]
    df = spark.createDataFrame(rows, "id long, vec array<long>").repartition(3)
    got, centroids = cluster(df, np.array(start), 4, shard_rows=64)
    want, c = plain_clusters(rows, start, 4)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert centroids.tolist() == c


def test_balls_go_whole():
    """Well parted groups and copies are assigned without a look at their vectors."""
    rng = np.random.default_rng(2)
    means = rng.integers(-5000, 5000, (8, 16))
    x = np.concatenate([m + rng.integers(-20, 20, (500, 16)) for m in means] + [np.repeat(means[:1], 4000, axis=0)])
    tree = Tree.unpack(16, Tree.build(x).pack())
    whole, singles = [], []
    seen = tree.assign(means, lambda node, c: whole.append(int(tree.count[node])), lambda p, c, d: singles.append(len(p)))
    assert sum(whole) + sum(singles) == len(x) and sum(singles) == 0 and seen < 64
    assert squared(x[:5], means).tolist() == [[int(((a - m) ** 2).sum()) for m in means] for a in x[:5]]


def test_op12_leaves_odd_vectors_out(spark, tmp_path):
    ship(spark)
    rng = random.Random(4)
    v = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(i, v(), "x", 0) for i in range(12)] + [(1, None, "x", 0), (2, v()[:63], "x", 0), (3, [*v()[:63], None], "x", 0), (4, [*v()[:63], float("nan")], "x", 0), (5, [*v()[:63], float("-inf")], "x", 0), (None, v(), "x", 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, id int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = q12_centroids.op12_centroids(spark, str(tmp_path)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted([*map(str, range(12)), "None"])
    assert len({r.inertia for r in got}) == 1 and sum(r.distance for r in got) == got[0].inertia
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{empty}/embeddings.parquet")
    assert q12_centroids.op12_centroids(spark, empty).collect() == []


LETTERS = {"xa": "abcde", "xb": "defgh", "xc": "абвгд"}


def made_up(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_languages_on_the_table(spark):
    ship(spark)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q11_langid.op11_langid(spark, SF).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


def test_languages_by_hand(spark, tmp_path):
    """Labels of held-out rows are not read; unknown scripts are rejected; nulls, blanks and copies have their results."""
    ship(spark)
    rng = random.Random(8)
    rows = [(i, made_up(rng, lang, rng.randint(20, 60)), lang) for i, lang in enumerate(["xa", "xb", "xc"] * 60)]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = [(i, t, "xa" if i in held else lang) for i, t, lang in rows]
    odd = [(1000, None, "xa"), (1001, "", "xa"), (1002, "12 + 3 ́ ...", "xb"), (None, made_up(rng, "xb", 30), "xa"), (1003, made_up(rng, "xa", 30), None), (1004, "一丁七 丈三", None), (1005, made_up(rng, "xb", 200_000), None), (1005, "DEFGH hgfed", None)]
    schema = "doc_id long, text string, lang string, nearest string, score int"
    spark.createDataFrame([(*r, "n", 1) for r in docs + odd], schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = q11_langid.op11_langid(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + len(odd)
    assert all(by[i].lang_pred == lang for i, _, lang in rows)
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert (by[None].lang_pred, by[None].held_out, by[1003].lang_pred) == ("xb", False, "xa")
    assert by[1004].rejected and not by[1003].rejected
    assert {r.lang_pred for r in got if r.doc_id == 1005} == {"xb"}
    for name, keep in (("none", "false"), ("unlabelled", "lang is null")):
        folder = str(tmp_path / name)
        spark.read.parquet(str(tmp_path / "documents.parquet")).where(keep).write.parquet(f"{folder}/documents.parquet")
        assert {r.lang_pred for r in q11_langid.op11_langid(spark, folder).collect()} <= {"und"}


def test_pieces_count_what_the_whole_text_does(monkeypatch):
    rng = random.Random(3)
    text = made_up(rng, "xa", 3000)
    (_, whole, _), = langid.count_grams([text])
    monkeypatch.setattr(langid, "PIECE_CHARS", 1000)
    (_, parts, some), = langid.count_grams([text])
    assert (whole == parts).all() and some.all()
    many = [made_up(rng, "xb", rng.randint(0, 90)) for _ in range(60)] + [None]
    together = np.zeros((61, langid.DIM))
    for places, counts, _ in langid.count_grams(many):
        together[places] = counts
    alone = np.concatenate([c for t in many for _, c, _ in langid.count_grams([t])])
    assert (together == alone).all()
