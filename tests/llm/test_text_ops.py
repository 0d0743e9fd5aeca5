"""Tokenising, packing, token files and toxicity against brute force, round trips and the tokenizers library."""

import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basalt.llm import bpe, simple8b
from basalt.llm.common import ship
from basalt.llm.packing import best_fit, pack_documents
from basalt.llm.token_files import documents_of, read_token_files, write_token_files
from basalt.llm.tokens import fast_ids, transcode
from basalt.llm.toxicity import Scorer, Trie, allowed_edits, scorer, train

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "  a  b \n\n c ", "\x1c a\x1d", "İSTANBUL ΣΑΣ", "x<|endoftext|> y", "a" * 1500, "ab" * 600, "é ́x", "the \t\t\n x  ", "don't I'LL 12345", "日本語🎉👩‍👩‍👧", "a\u0085b c", "\n x \n", ":\U0003d000", "a\U0003d000  b\ue000 :\U0003d000"]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("by", ["transducer", "core"])
def test_encoders_equal_the_library(path, by):
    lib, fast = bpe.library(path), fast_ids(path, by)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aeioutsr THEé'ß\n1.,🎉$-") for _ in range(rng.randrange(90))) for _ in range(150)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(fast(t), "<u4").tolist() == want
        assert bpe.encoder(path).decode(want) == lib.decode(want, skip_special_tokens=False)


def test_a_process_remembers_for_one_operator():
    """Spark's workers serve one stage after another; tables and memos of all operators stood in each of them."""
    from basalt.llm.ngram_join import doc_shingles

    fast = fast_ids(BYTE, "core")
    want, gone = fast("a few words"), weakref.ref(fast)
    assert fast_ids(BYTE, "core") is fast
    del fast
    first = weakref.ref(scorer(["awful"], ["awful"], []))
    assert gone() is None and scorer(["awful"], ["awful"], []) is first()
    second = weakref.ref(scorer(["awful"], ["awful"], ["lawful"]))
    assert first() is None and second() is not None
    sets = doc_shingles(["one two three four five six"], 5)
    assert second() is None and len(sets[0]) == 2
    assert fast_ids(BYTE, "core")("a few words") == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(t):
    assert bpe.encoder(WORD).encode(t) == bpe.library(WORD).encode(t, add_special_tokens=False).ids


def test_transducer_holds_a_bounded_part():
    enc = bpe.encoder(WORD)
    run = bpe.Transducer(enc.table)
    assert len(list(run.word("hella" * 4000))) > 1000
    assert run.held_most <= 2 * enc.table.longest + enc.table.sufficient_lookahead()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=400))
def test_simple8b_round_trip(ids):
    got, lens = simple8b.decode_block(simple8b.encode_block(np.array(ids, dtype=np.uint32), np.array([len(ids)])))
    assert got.tolist() == ids and lens.tolist() == [len(ids)]


DOCS = [(3, "the cat sat", "x"), (1, None, None), (2, "", "y"), (None, "the cat sat", "z"), (3, "the cat sat", "x"), (9, "word " * 5000, "w")]


def _docs(spark, rows=DOCS):
    ship(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def test_transcode_handles_nulls(spark):
    got = {(r.doc_id, r.length): r for r in transcode(_docs(spark), WORD).collect()}
    assert got[1, None].ids == [] and got[1, None].decoded == "" and len(got[9, "w"].ids) == 5000
    assert transcode(_docs(spark, []), WORD).count() == 0


def test_best_fit_fills_bins():
    bins = best_fit([7, 5, 5, 3, 10], 10)
    assert sorted(sum(([7, 5, 5, 3, 10][i] for i in b), 0) for b in bins) == [10, 10, 10]


def test_packing(spark):
    out = pack_documents(_docs(spark), BYTE).collect()
    assert len([r for r in out if r.doc_id == 3]) == 2
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 9)
    assert long[0][2] <= 2048 and all(x[2] == 2048 for x in long[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:], strict=False))
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and p[-1][0] + p[-1][1] <= 2048
    assert len(places) == -(-sum(r.length for r in out) // 2048)
    assert pack_documents(_docs(spark, []), BYTE).count() == 0


def test_token_files(spark, tmp_path):
    write_token_files(_docs(spark), f"{tmp_path}/f", WORD, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in documents_of(read_token_files(spark, f"{tmp_path}/f")).collect())
    lib, at, want = bpe.library(WORD), 0, []
    for i, t in sorted(((d, t or "") for d, t, _ in DOCS), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def test_automaton_equals_brute_force():
    rng = random.Random(0)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi)))
    terms = sorted({word(3, 13) for _ in range(60)})
    trie = Trie(terms)
    for _ in range(800):
        w = word(2, 14)
        assert trie.nearest(w) == min(((_distance(w, t), t) for t in terms if _distance(w, t) <= allowed_edits(t)), default=None)


def test_quotation_is_not_abuse():
    s = Scorer(["idiot"], ["idiot"], frozenset())
    assert s.figures('they said "what an idiot" once')[3] > 0 and s.figures("> idiot\nok")[1] == 0
    assert s.figures("you 1diot")[2] > 0 and s.figures(None)[1] == 0


def test_toxicity_learns(spark):
    ship(spark)
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30)) + (" vilething" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "some vilethin here"), (902, "clean")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in train(docs, labels).score(docs).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400)) and got[900] == got[902] == 0
    empty = train(docs.limit(0), labels)
    assert empty.score(docs).count() == docs.count()


def test_misspellings_count_whatever_the_corpus_size(spark):
    """Ten and a thousand times the documents, with as many times the rare clean words near a term; no neighbour is cut."""
    import itertools

    from basalt.llm.common import Stash, ship
    from basalt.llm.toxicity import neighbours

    ship(spark)
    letters, term = "abcdefghijklmnopqrstuvwxyz0123456789", "stupidhead"
    near = [term[:i] + x + term[i + 1 : j] + y + term[j + 1 :] for i, j in itertools.combinations(range(10), 2) for x in letters if x != term[i] for y in letters if y != term[j]]
    for size, words in ((10, 2), (1000, 200), (100_000, 54_000)):
        rows = [("", 100 * size, 1000 * size, 500 * size), ("stupidheadd", 20 * size, 0, 0), *[(w, 0, 1 if k < size // 5 else 5, 1) for k, w in enumerate(near[:words])]]
        loose, clean = neighbours(spark.createDataFrame(rows, "word string, t long, c long, a long"), [term], "c", Stash(spark, "t"))
        assert loose == [term] and clean == sorted(near[:words])
    crowd = [("", 100, 1000, 500), *[(w, 0, 1, 1) for w in near[:50]]]
    assert neighbours(spark.createDataFrame(crowd, "word string, t long, c long, a long"), [term], "c", Stash(spark, "t")) == ([], [])
