"""Periodic runs of words, found on a harmonic grid, and texts without their repeats.

Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least max(6, 4 * q) words, which no neighbouring word extends keeping period q.

A run of period q holds more than 3 * q places i whose word equals the one at i + q, so a grid of that step meets each
run. Over all periods that makes n / 3 * (1 + 1/2 + 1/3 + ...) pairs (period, grid point). Pairs of equal words are
extended both ways, all at once, by a binary search over prefix hashes for the longest common extension. Multiples of a
run's period give the same stretch, of which the least period stays. Hashes never decide: the words of every run are
compared, and a pair whose hash was wrong is extended word by word.

Several texts share one slice of words, so short texts cost no calls of their own; nothing is extended over a text's
end. A text is held whole by its task, at some hundred bytes a word. Null and blank texts have no words, no runs and an
empty collapsed text; columns of the same names as the results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words of a slice, pairs that are looked at together.
SLICE_WORDS, PAIRS = 200_000, 1_000_000
#: A prime and the base of the polynomial over it; products of two values stay below 2^62.
PRIME, BASE = 2_147_483_647, 1_000_003_919
LEAST, TIMES = 6, 4

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def least_length(period):
    return np.maximum(LEAST, TIMES * period)


class Prefixes:
    """Prefix sums of word * BASE^place: equal stretches have equal sums, but for a shift."""

    def __init__(self, words: np.ndarray, prime: int = PRIME):
        self.prime = p = np.uint64(prime)
        n = len(words)
        self.power = np.ones(n + 1, dtype=np.uint64)
        done = 1
        while done <= n:
            take = min(done, n + 1 - done)
            self.power[done : done + take] = self.power[:take] * (self.power[done - 1] * np.uint64(BASE) % p) % p
            done += take
        value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value % p * self.power[:n] % p, out=self.sums[1:])
        self.sums %= p

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """May words from i on and from j on (i < j) be equal over `length`? Only a yes can be wrong."""
        p, s = self.prime, self.sums
        return (s[i + length] + p - s[i]) % p * self.power[j - i] % p == (s[j + length] + p - s[j]) % p


def longest(same: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The greatest length (0 to most) of which `same` says yes; all pairs are searched at once."""
    low, high = np.zeros_like(most), most + 1
    while True:
        open_ = high - low > 1
        if not open_.any():
            return low
        mid = np.where(open_, (low + high) >> 1, low)
        yes = same(mid)
        low, high = np.where(yes, mid, low), np.where(yes, high, np.where(open_, mid, high))


def grid(n: int, most_period: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of all grid points of all periods, in bounded lots."""
    periods = np.arange(1, most_period + 1)
    steps = least_length(periods) - periods
    points = -(-np.maximum(n - periods, 0) // steps)
    ends = np.cumsum(points)
    first = 0
    while first < most_period:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        take = slice(first, last)
        q = np.repeat(periods[take], points[take])
        start = np.repeat(ends[take] - points[take] - before, points[take])
        yield q, (np.arange(len(q)) - start) * np.repeat(steps[take], points[take])
        first = last


def runs_of(words: np.ndarray, lengths: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs in texts laid end to end. words: a number for
    each; lengths: words of each text; starts count from the first text's first word."""
    n, most = len(words), int(lengths.max(initial=0)) // TIMES
    if most < 1 or n < LEAST:
        return np.zeros((0, 3), dtype=np.int64)
    ends = np.cumsum(lengths)
    text_end, text_start = np.repeat(ends, lengths), np.repeat(ends - lengths, lengths)
    found = []  # start, end, period, anchor
    hashes = None
    for q, i in grid(n, most):
        hit = np.flatnonzero(words[i] == words[i + q])
        hit = hit[i[hit] + q[hit] < text_end[i[hit]]]
        if not len(hit):
            continue
        hashes = hashes or Prefixes(words, prime)
        q, i = q[hit], i[hit]
        ahead = longest(lambda m: hashes.same(i, i + q, m), text_end[i] - i - q)  # noqa: B023
        behind = longest(lambda m: hashes.same(i - m, i + q - m, m), i - text_start[i])  # noqa: B023
        keep = ahead + behind + q >= least_length(q)
        found.append(np.stack([i - behind, i + q + ahead, q, i], axis=1)[keep])
    rows = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    while True:
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        wrong = [k for k in np.flatnonzero(new).tolist() if not _holds(words, *rows[k, :3].tolist())]
        if not wrong:
            break
        fixed = [_extended(words, int(text_start[i]), int(text_end[i]), q, i) for q, i in rows[wrong, 2:].tolist()]
        fixed = [r for r in fixed if r[1] - r[0] >= least_length(r[2])]
        rows = np.concatenate([np.delete(rows, wrong, axis=0), np.array(fixed, dtype=np.int64).reshape(-1, 4)])
    rows = rows[new]
    return np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)


def _holds(words: np.ndarray, start: int, end: int, q: int) -> bool:
    return bool((words[start : end - q] == words[start + q : end]).all())


def _extended(words: np.ndarray, first: int, end: int, q: int, i: int) -> tuple[int, int, int, int]:
    """The stretch of period q around the equal words i and i + q, word by word."""
    ahead = words[i : end - q] != words[i + q : end]
    behind = (words[first:i] != words[first + q : i + q])[::-1]
    f = int(ahead.argmax()) if ahead.any() else len(ahead)
    b = int(behind.argmax()) if behind.any() else len(behind)
    return i - b, i + q + f, q, i


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words without those that any run holds after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _slices(texts: list, keys: list, rewrite: Rewrite | None) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(row, words) in slices, texts of like size together."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
    lot, held = [], 0
    for k in order:
        words = (texts[k] or "").encode().split()  # bytes are split at just the six ASCII blanks
        if rewrite and words:
            words = rewrite(keys[k], words)
        lot.append((k, words))
        held += len(words)
        if held >= SLICE_WORDS:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def find_runs(docs: DataFrame, key: str, text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """key, runs (array of start, length, period; by start, then period) and collapsed (the words that stay, joined by one
    space) of each row. rewrite(key, words) may change a text's words first. One row in, one row out; no shuffle."""
    key_type = docs.schema[key].dataType
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([T.StructField(key, key_type), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lot in _slices(texts, keys, rewrite):
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                lengths = np.array([len(w) for _, w in lot], dtype=np.int64)
                ids = np.fromiter((number[x] for _, w in lot for x in w), dtype=np.int64, count=int(lengths.sum()))
                runs = runs_of(ids, lengths)
                ends = np.cumsum(lengths)
                cuts = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
                rows, texts_out = [], []
                for (_, words), a, b, start in zip(lot, cuts[:-1], cuts[1:], (ends - lengths).tolist(), strict=True):
                    own = runs[a:b] - np.array([start, 0, 0])
                    rows.append(own)
                    texts_out.append(b" ".join(collapsed(words, own)))
                flat = np.concatenate(rows)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run_type))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k for k, _ in lot])), pa.ListArray.from_arrays(offsets, structs), pa.array(texts_out, pa.binary()).cast(pa.string())],
                    names=[key, "runs", "collapsed"],
                )

    return docs.select(key, text).mapInArrow(task, schema)
