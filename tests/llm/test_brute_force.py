"""Toxicity, line dedup and every stage of the pipeline against plain loops over a small corpus."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as pipeline
import public_tokenizers
from basalt.llm import bpe, registry
from basalt.llm.common import ship
from basalt.llm.line_dedup import dedup_lines
from basalt.llm.toxicity import ADDRESS, LEET, QUOTES, WINDOW, allowed_edits, bare, train

BLANK = " \t\n\x0b\x0c\r"


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def score(model, text):
    """The score of one text, word by word and term by term."""
    clean, terms = set(model.clean), set(model.terms)

    def near(word):
        return any(distance(word, t) <= allowed_edits(t) for t in model.loose)

    def kind(chunk):
        word = bare(chunk)
        if word in terms:
            return 1
        if len(word) < 4 or word in clean:
            return 0
        plain = word.translate(LEET)
        return 2 if near(word) or (plain != word and plain not in clean and near(plain)) else 0

    chunks, quoted = [], []
    for line in (text or "").lower().split("\n"):
        own = line.split()
        flags = [line.lstrip().startswith(">")] * len(own)
        i = 0
        while i < len(own):
            c = own[i]
            if c[0] in QUOTES:
                close = QUOTES[c[0]]
                end = next((j for j in range(i, len(own)) if close in (own[j][1:] if j == i else own[j])), None)
                if end is not None:
                    flags[i : end + 1] = [True] * (end + 1 - i)
                    i = end + 1
                    continue
                break
            i += 1
        chunks += own
        quoted += flags
    kinds = [kind(c) for c in chunks]
    hits = [i for i, k in enumerate(kinds) if k]
    free = [i for i in hits if not quoted[i]]
    addressed = sum(any(bare(c) in ADDRESS for c in chunks[max(0, i - WINDOW) : i + WINDOW + 1]) for i in free)
    dense = max([sum(1 for j in hits if i <= j <= i + WINDOW) for i in free], default=0)
    plain, fuzzy = sum(kinds[i] == 1 for i in free), sum(kinds[i] == 2 for i in free)
    x = [1.0, math.log1p(plain), math.log1p(fuzzy), math.log1p(len(hits) - len(free)), math.log1p(addressed), float(min(dense, 8)), float(plain > 0)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def kept_lines(docs):
    """(row, place) of the lines that go, of (id, text) rows in order; lines alike by 0.8, directly or not, are one."""
    places = [(i, r, p, line) for r, (i, t) in enumerate(docs) for p, line in enumerate((t or "").split("\n")) if line.strip(BLANK)]
    lines = sorted({x[3] for x in places})
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    at = {x: find(k) for k, x in enumerate(lines)}
    groups = {}
    for i, r, p, line in places:
        groups.setdefault(at[line], []).append((i, r, p))
    return groups


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [prose(14) for _ in range(4)]
    rows = []
    for i in range(230):
        text = prose(45)
        if i % 5 == 0:
            text += "\n" + rng.choice(shared) + rng.choice(["", "!", " x"])
        if i % 6 == 1:
            text += f" you {prose(1)} vilething {prose(1)} grotword {prose(4)}"
        if i % 30 == 1:
            text = text.replace("vilething", "vilethinq")
        rows.append((i, text, ("en", "de")[i % 2], "web", len(text)))
    for k, i in enumerate((2, 3, 8, 9, 14)):
        text = rows[i][1] + " extra" * (k % 2)
        rows.append((300 + k, text, "en", "web", len(text)))
    rows += [(2, *rows[2][1:]), (400, None, None, None, None), (401, "", "en", None, 0), (402, 'they said "vilething" once ' + prose(30), "en", "x", 0), (403, "few words", "de", "x", 9), (404, "word " * 60, "en", "x", 300)]
    labels = [(i, 1, int(i % 6 == 1)) for i in range(230)] + [(403, 0, 0), (None, 1, 1), (9999, 0, 1)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_scores_equal_a_plain_loop(spark, corpus):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    assert {"vilething", "grotword"} <= set(model.terms)
    got = model.score(docs, keep_text=True).collect()
    assert len(got) == docs.count() and max(abs(r.score - score(model, r.text)) for r in got) < 1e-9


def test_lines_equal_a_plain_loop(spark, corpus):
    ship(spark)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = dedup_lines(docs).collect()
    before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    gone = sum(len(r.removed) for r in out)
    groups = kept_lines(before)
    assert gone == sum(len(g) - 1 for g in groups.values()) and gone > 40
    for g in groups.values():  # of each group the line with the least id stays
        least = min(i for i, _, _ in g if i is not None)
        texts = [t for i, t in before if i == least]
        assert any(set((r.text or "").split("\n")) & {line for t in texts for line in t.split("\n")} for r in out if r.doc_id == least) or len({i for i, _, _ in g}) == 1


def test_each_stage_equals_plain_loops(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    stages = dict(pipeline.STAGES)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)

    model = train(docs, labels)
    calm = stages["toxicity"](spark, docs, corpus)
    assert rows(calm) == sorted((tuple(r) for r in docs.collect() if score(model, r.text) < 0.5), key=str) and calm.count() < docs.count()
    calm.write.parquet(f"{corpus}/s1")

    calm = spark.read.parquet(f"{corpus}/s1")
    good = stages["quality"](spark, calm, corpus)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{corpus}/s1/*.parquet'")
    db.execute(f"CREATE VIEW labels AS SELECT * FROM '{corpus}/labels.parquet/*.parquet'")
    kept = {r[0] for r in db.execute(f"SELECT doc_id FROM ({registry.oracle_sql()['op8_quality']}) WHERE kept").fetchall()}
    kept.add(2)  # two rows have this id; SQL counts their windows together
    assert rows(good) == sorted((tuple(r) for r in calm.collect() if r.doc_id in kept), key=str) and 403 not in kept and 404 not in kept
    good.write.parquet(f"{corpus}/s2")

    good = spark.read.parquet(f"{corpus}/s2")
    unique = stages["line_dedup"](spark, good, corpus)
    assert unique.columns == docs.columns and unique.count() == good.count()
    unique.write.parquet(f"{corpus}/s3")
    unique = spark.read.parquet(f"{corpus}/s3")
    left = [(r.doc_id, r.text) for r in unique.collect()]
    assert all(len(g) == 1 for g in kept_lines(left).values()) and all(r.n_chars == len(r.text or "") for r in unique.collect())

    near = stages["near_dedup"](spark, unique, corpus)
    sets = [shingles(t) for _, t in left]
    group = list(range(len(left)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert near.count() == len(set(group)) and near.columns == docs.columns

    packed = stages["packing"](spark, near, corpus).collect()
    lib, want = bpe.library(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in near.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in packed) == sorted(want)
    final = pipeline.run(spark, corpus).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in final) == sorted(want)


def _edited(rng, base, keep):
    """base with places replaced until the Jaccard similarity of 5-grams is just above `keep`."""
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    jaccard = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    now = list(base)
    while True:
        new = list(now)
        new[rng.randrange(len(new))] = rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.random())[2:8] if len(base[0]) > 1 else rng.choice("abcdefghijklmnopqrstuvwxyz")
        if jaccard(base, new) < keep:
            return now
        now = new


@pytest.mark.parametrize("similarity", [0.5, 0.65, 0.8])
def test_pairs_just_above_any_similarity_are_found(spark, similarity):
    """Of 150 pairs at the bar, texts and lines, 99 % are found, and nothing that is no pair."""
    from basalt.llm.ngram_join import near_duplicates

    ship(spark)
    rng = random.Random(int(similarity * 100))
    docs, lines = [], []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(_edited(rng, words, similarity)))]
        line = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90)]
        lines += [(2 * k, "".join(line)), (2 * k + 1, "".join(_edited(rng, line, similarity)))]
    got = {r.doc_id: (r.class_id, r.links) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), similarity=similarity).collect()}
    assert sum(got[2 * k + 1] == (2 * k, 1) for k in range(150)) >= 149 and all(c // 2 == i // 2 for i, (c, _) in got.items())
    kept = dedup_lines(spark.createDataFrame(lines, "doc_id long, text string"), similarity=similarity).collect()
    assert sum(r.removed == [0] and r.doc_id % 2 == 1 for r in kept) >= 149 and all(r.removed == [] for r in kept if r.doc_id % 2 == 0)


def test_similarities_that_signatures_cannot_find_are_refused(spark):
    from basalt.llm.ngram_join import near_duplicates

    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for f in (near_duplicates, dedup_lines):
        with pytest.raises(ValueError):
            f(df, similarity=0.01)


def test_a_text_of_many_equal_lines(spark):
    """Half a million lines, of which three stay."""
    ship(spark)
    text = "\n".join(["the same line once more"] * 500_000 + ["", "another line at the end", "the same line once more"])
    (row,) = dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == "the same line once more\n\nanother line at the end" and len(row.removed) == 500_000 and row.n_lines == 500_003
