"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, and scores of each hit's context window.

1. Words that labelled toxic documents hold far more often than clean ones (G-test with Bonferroni correction over
   the words seen, and a least log ratio) make the lexicon; counts are over all labelled training rows.
2. A word of a text hits a term if the term's Levenshtein automaton accepts it: the automaton's states are run down
   the trie, so shared beginnings are done once and dead branches end early. Words that clean documents hold
   are no misspellings.
3. A hit's window tells quotation (quote marks that open and close on one line, a quoted line) from abuse (someone is
   addressed, hits cluster).
4. A logistic model over these figures gives the score; it is fitted on a bounded sample (SAMPLE rows) of the
   training rows, with a prior that holds where the sample says nothing.

Training rows: a label that isn't null, and crc32(id as text) mod 5 not 0. Neither labels, lang, source nor id enter
a score. Null and empty texts have no hits and get the model's lowest scores. With no toxic training rows the lexicon
is empty. Repeated ids are scored each by itself; their label counts for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import Stash, held, let_go
from .tokens import free_name

FOLDS = 5
#: Rows that the logistic model is fitted on at most; labels to broadcast (more are joined by a shuffle).
SAMPLE, SMALL_LABELS = 20_000, 1_000_000
#: Words that a worker remembers; words that it counts before it hands them on.
MEMO, COUNTED = 100_000, 200_000
LEAST_LOG_RATIO, WINDOW, CROWDED = 2.0, 8, 3
#: Fixed values.
EDGES = ".,;:!?\"'()[]{}<>«»„“”‚‘’…-–—*_~`|/\\#%&+="
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti tus eres".split())
FEATURES = ("bias", "plain", "fuzzy", "quoted", "addressed", "dense", "any_plain")
PRIOR = np.array([-3.0, 2.0, 1.0, -0.5, 0.5, 0.3, 2.0])


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


def bare(chunk: str) -> str:
    return chunk.strip(EDGES)


class Trie:
    """Terms by their letters. A node is [children, term or None, edits, least, most]: the most edits that a term below it
    allows, and the least and greatest length of such terms."""

    def __init__(self, terms: list[str]):
        self.root: list = [{}, None, 0, 1 << 30, 0]
        self.terms = set(terms)
        for term in terms:
            node = self.root
            self._mark(node, term)
            for c in term:
                node = node[0].setdefault(c, [{}, None, 0, 1 << 30, 0])
                self._mark(node, term)
            node[1] = term
        # a term within k edits of a word has one of its k + 1 parts in the word unchanged, moved by k at most
        places: dict[int, dict[tuple[int, int], set[str]]] = {}
        for term in terms:
            k = allowed_edits(term)
            for part, at in self._cut(term):
                for length in range(len(term) - k, len(term) + k + 1):
                    for moved in range(max(0, at - k), at + k + 1):
                        places.setdefault(length, {}).setdefault((moved, moved + len(part)), set()).add(part)
        self.places = {n: [(a, b, frozenset(parts)) for (a, b), parts in x.items()] for n, x in places.items()}

    @staticmethod
    def _cut(term: str) -> list[tuple[str, int]]:
        n, k = len(term), allowed_edits(term) + 1
        at = [round(i * n / k) for i in range(k + 1)]
        return [(term[a:b], a) for a, b in zip(at, at[1:], strict=False)]

    def might(self, word: str) -> bool:
        return any(word[a:b] in parts for a, b, parts in self.places.get(len(word), ()))

    @staticmethod
    def _mark(node: list, term: str) -> None:
        node[2], node[3], node[4] = max(node[2], allowed_edits(term)), min(node[3], len(term)), max(node[4], len(term))

    def nearest(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the closest accepted term: the automaton of `word` run down the trie.

        The automaton's states are bits: bit i of the e-th number says that i letters of the word are read with e edits
        at most. A branch ends where no state is alive, or no term below is of a length that could be accepted.
        """
        if word in self.terms:
            return 0, word
        if not self.might(word):
            return None
        best: tuple[int, str] | None = None
        n = len(word)
        end, every = 1 << n, (2 << n) - 1
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        where = at.get
        todo = [(self.root, 1, 3 & every, 7 & every)]
        while todo:
            node, r0, r1, r2 = todo.pop()
            for c, child in node[0].items():
                edits = child[2]
                if n > child[4] + edits or n < child[3] - edits:
                    continue
                m = where(c, 0)
                q0 = (r0 & m) << 1
                q1 = q2 = 0
                if edits:
                    q1 = ((r1 & m) << 1 | r0 | r0 << 1 | q0 << 1 | q0) & every
                    if edits > 1:
                        q2 = ((r2 & m) << 1 | r1 | r1 << 1 | q1 << 1 | q1) & every
                if not (q0 | q1 | q2):
                    continue
                term = child[1]
                if term is not None:
                    e = 0 if q0 & end else 1 if q1 & end else 2 if q2 & end else 3
                    if e <= allowed_edits(term) and (best is None or (e, term) < best):
                        best = e, term
                todo.append((child, q0, q1, q2))
        return best


class Scorer:
    """Figures of a text's hits."""

    def __init__(self, terms: list[str], loose: list[str], clean: frozenset[str]):
        """loose: the terms whose misspellings count."""
        self.terms, self.trie, self.clean = set(terms), Trie(loose), clean
        self.words = Memo(self._kind, 2 * MEMO)
        self.memo = Memo(lambda chunk: self.words[bare(chunk)], MEMO)

    def _kind(self, word: str) -> int:
        """0: no hit, 1: a term, 2: a misspelling."""
        if word in self.terms:
            return 1
        if len(word) < 4 or word in self.clean:
            return 0
        if self.trie.nearest(word):
            return 2
        plain = word.translate(LEET)
        return 2 if plain != word and plain not in self.clean and self.trie.nearest(plain) else 0

    def figures(self, text: str | None) -> tuple[float, ...]:
        chunks = (text or "").lower().split()
        kinds = list(map(self.memo.__getitem__, chunks))
        plain = fuzzy = quoted = addressed = 0
        dense = 0
        if any(kinds):
            hits = [i for i, k in enumerate(kinds) if k]
            inside = self._inside_quotes(text or "", chunks)
            for h, i in enumerate(hits):
                if inside[i]:
                    quoted += 1
                    continue
                plain, fuzzy = plain + (kinds[i] == 1), fuzzy + (kinds[i] == 2)
                around = chunks[max(0, i - WINDOW) : i + WINDOW + 1]
                addressed += any(bare(c) in ADDRESS for c in around)
                near = sum(1 for j in hits[h : h + WINDOW] if j - i <= WINDOW)
                dense = max(dense, near)
        return (1.0, math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), float(min(dense, 8)), float(plain > 0))

    @staticmethod
    def _inside_quotes(text: str, chunks: list[str]) -> list[bool]:
        """Per chunk: does it stand in an opened and later closed quote, or on a line that starts with '>'?"""
        out = [False] * len(chunks)
        i = 0
        for line in text.lower().split("\n"):
            n = len(line.split())
            if line.lstrip().startswith(">"):
                out[i : i + n] = [True] * n
            opened, close = None, ""
            for j in range(i, i + n):
                c = chunks[j]
                if opened is None and c[:1] in QUOTES:
                    opened, close = j, QUOTES[c[0]]
                    c = c[1:]
                if opened is not None and close in c:
                    out[opened : j + 1] = [True] * (j + 1 - opened)
                    opened = None
            i += n
        return out


def scorer(terms: list[str], loose: list[str], clean: list[str]) -> Scorer:
    key, scorers = (tuple(terms), tuple(loose), tuple(clean)), held("toxicity")
    if key not in scorers:
        scorers.clear()
        let_go()  # a scorer and its memos refer to each other
        scorers[key] = Scorer(terms, loose, frozenset(clean))
    return scorers[key]


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    if marks.count() <= SMALL_LABELS:  # sixteen bytes each
        marks = F.broadcast(marks)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, F.col("id") == F.col("__id")).select("id", "text", "toxic", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2)).cast("int").alias("half"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, t, c, a: toxic and clean documents that hold it, and clean ones of the first half; '' counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")  # what the worker remembers for others goes before it counts
        strip = bare
        sums = {"t": Counter(), "c": Counter(), "a": Counter()}

        def out() -> pa.RecordBatch:
            words = list(sums["t"].keys() | sums["c"].keys())
            b = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([s[w] for w in words], pa.int64()) for s in sums.values()]], names=["word", *sums])
            for s in sums.values():
                s.clear()
            return b

        for batch in batches:
            for text, toxic, half in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words = set(map(strip, set((text or "").lower().split())))
                words.add("")
                sums["t" if toxic else "c"].update(words)
                if not toxic and half == 0:
                    sums["a"].update(words)
                if sum(map(len, sums.values())) > COUNTED:
                    yield out()
        yield out()

    counted = rows.select("text", "toxic", "half").mapInArrow(run, "word string, t long, c long, a long")
    return counted.groupBy("word").agg(*[F.sum(n).alias(n) for n in ("t", "c", "a")])


def contexts(rows: DataFrame, words: list[str]) -> DataFrame:
    """word, t, c: between how many different pairs of neighbours each word stands in documents of either label.

    Copies of a document repeat its words with their neighbours, so they count once.
    """
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        strip = bare
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks = ["", *(text or "").lower().split(), ""]
                for i, w in enumerate(map(strip, chunks)):
                    if w in wanted and 0 < i < len(chunks) - 1:
                        found.add((w, toxic, f"{chunks[i - 1]} {chunks[i + 1]}"))
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["word", "toxic", "around"])

    seen = rows.select("text", "toxic").mapInArrow(run, "word string, toxic int, around string").select("word", "toxic", F.xxhash64("around").alias("around")).distinct()
    return seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def lexicon(counts: DataFrame, rows: DataFrame) -> list[str]:
    """All terms with evidence, over documents first and then again over different contexts.

    The bar grows with the words seen, so their number follows what the labels tell and not the vocabulary.
    """
    total = counts.where("word = ''").first()
    n_t, n_c = (total["t"], total["c"]) if total else (0, 0)
    if not n_t:
        return []
    seen = counts.where("word <> '' AND t + c >= 3")
    bar = 2 * math.log(max(seen.count(), 1) / 0.05)
    n = n_t + n_c

    def best(df: DataFrame) -> list[str]:
        t, c = F.col("t"), F.col("c")
        part = lambda k, share: F.when(k > 0, k * F.log(k / ((t + c) * share))).otherwise(0.0)
        g = 2 * (part(t, n_t / n) + part(c, n_c / n))
        ratio = F.log((t + 0.5) / (n_t + 1.0)) - F.log((c + 0.5) / (n_c + 1.0))
        found = df.where((g >= bar) & (ratio >= LEAST_LOG_RATIO) & (F.length("word") >= 3)).select("word")
        return sorted(r["word"] for r in found.collect())

    first = best(seen)
    return best(contexts(rows, first)) if first else []


def neighbours(counts: DataFrame, terms: list[str], by: str, stash: Stash) -> tuple[list[str], list[str]]:
    """(loose, clean): terms whose misspellings tell something, and all clean words near those.

    Known clean words are no misspellings, so what matters is how many documents hold other words inside a term's
    automaton. Of new clean documents that share is about the number of its words that one clean document holds, over
    all clean documents (Good and Turing); of toxic ones, it is counted over the words that clean documents lack. A term
    is crowded, and only counts as it is, if the clean share is the greater one and CROWDED such words show it. Shares
    don't grow with the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(terms, terms, [])
        for batch in batches:
            near = [s.trie.nearest(w) if len(w) >= 4 and w not in s.terms else None for w in batch.column(0).to_pylist()]
            hit = pa.array([x is not None for x in near], pa.bool_())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(hit) for i in range(3)], pa.array([x[1] for x in near if x], pa.string())], names=["word", "n", "t", "term"])

    if not terms:
        return [], []
    total = counts.where("word = ''").select(F.col(by).alias("n"), "t").first()
    seen = counts.where((F.col("word") != "") & ((F.col(by) > 0) | (F.col("t") > 0))).select("word", F.col(by).alias("n"), "t")
    near = stash.put(seen.mapInArrow(run, "word string, n long, t long, term string"), "near")
    sums = near.groupBy("term").agg(F.count_if(F.col("n") == 1).alias("once"), F.sum(F.when(F.col("n") == 0, F.col("t")).otherwise(0)).alias("t"))
    share = lambda k, n: (k + 0.5) / (n + 1.0)
    crowded = {r["term"] for r in sums.collect() if r["once"] >= CROWDED and share(r["once"], total["n"]) > share(r["t"], total["t"])}
    known = near.where("n > 0").select("word", "term").toArrow().to_pydict()
    return [t for t in terms if t not in crowded], sorted(w for w, t in zip(known["word"], known["term"], strict=True) if t not in crowded)


def fit(x: np.ndarray, y: np.ndarray, strength: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to PRIOR."""
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        w = w - step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def figures(rows: DataFrame, keep: list[str], text: Column, terms: list[str], loose: list[str], clean: list[str]) -> tuple[DataFrame, str]:
    """The columns keep and one more, the figures of text, and that one's name."""
    from pyspark.sql import types as T

    f = free_name(rows, "f")
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField(f, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(terms, loose, clean)
        for batch in batches:
            got = [s.figures(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(got, pa.list_(pa.float64()))], names=[*keep, f])

    return rows.select(*keep, text.alias(free_name(rows, "__text"))).mapInArrow(run, schema), f


class Model:
    def __init__(self, terms: list[str], loose: list[str], clean: list[str], weights: np.ndarray):
        self.terms, self.loose, self.clean, self.weights = terms, loose, clean, weights

    def score(self, docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
        """All columns of docs (keep_text: the text, too), score, predicted, and hits: [plain, misspelled, quoted].

        Names that docs has already get underscores; `names` tells them.
        """
        keep = [c for c in docs.columns if keep_text or c != text_col]
        rows, f = figures(docs, keep, F.col(text_col), self.terms, self.loose, self.clean)
        logit = sum((F.col(f)[i] * float(w) for i, w in enumerate(self.weights)), F.lit(0.0))
        score = 1 / (1 + F.exp(-logit))
        hits = F.array(*[F.round(F.exp(F.col(f)[i]) - 1).cast("long") for i in (1, 2, 3)])
        names = self.names(docs)
        return rows.select(*keep, score.alias(names[0]), (score >= 0.5).cast("int").alias(names[1]), hits.alias(names[2]))

    @staticmethod
    def names(docs: DataFrame) -> tuple[str, str, str]:
        return free_name(docs, "score"), free_name(docs, "predicted"), free_name(docs, "hits")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stash: Stash | None = None) -> Model:
    stash = stash or Stash(docs.sparkSession, "toxicity")
    rows = training_rows(docs, labels, id_col, text_col)
    counts = stash.put(word_counts(rows), "counts")
    terms = lexicon(counts, rows)
    loose, clean = neighbours(counts, terms, "c", stash)
    # the fit sees misspellings as new documents show them: it takes the clean words of the other half only
    fitted, f = figures(_sampled(rows.where("half = 1")), ["toxic"], F.col("text"), terms, *neighbours(counts, terms, "a", stash))
    fitted = stash.put(fitted, "fit").limit(SAMPLE).collect()
    if not fitted:
        return Model(terms, loose, clean, PRIOR)
    x, y = np.array([r[f] for r in fitted]), np.array([r["toxic"] for r in fitted], dtype=float)
    return Model(terms, loose, clean, fit(x, y))


def _sampled(rows: DataFrame) -> DataFrame:
    """About SAMPLE rows, rather fewer: those whose id's hash is below a rate. The caller's limit only guards."""
    n = rows.select("toxic").count()
    top = 1 << 20
    keep = top if n <= SAMPLE else int(top * SAMPLE * 0.95 / n)
    return rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(top)) < keep)
