"""Shingles, MinHash signatures and exact Jaccard similarity, on flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Shingles that are hashed at once; sized for a processor's cache.
CHUNK = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(items: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k items inside each list, and their number by list; a shorter list is one run.

    Runs are hashed as if the lists were one; those that cross an end are left out.
    """
    lens = lens.astype(np.int64)
    counts = np.where(lens >= k, lens - k + 1, (lens > 0).astype(np.int64))
    total = int(lens.sum())
    starts = np.cumsum(lens) - lens
    padded = np.concatenate([items, np.zeros(k - 1, dtype=np.uint64)]) + np.uint64(1)
    h = padded[:total].copy()
    for j in range(1, k):
        h *= _MIX
        h += padded[j : j + total]
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for j in range(k):
            own = own * _MIX + np.where(lens[short] > j, padded[np.minimum(starts[short] + j, total - 1)], np.uint64(0))
        h[starts[short]] = own
    inside = np.ones(total, dtype=bool)
    lost = lens - counts  # the last places of each list start no run
    inside[np.repeat(starts + counts - (np.cumsum(lost) - lost), lost) + np.arange(int(lost.sum()))] = False
    return mix(h[inside]), counts


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n MinHash values (uint32) per list; lists without shingles get the largest value.

    The shingles' hashes are mixed already, so a random odd factor modulo 2^32 is enough to order them anew.
    """
    rng = np.random.default_rng(seed)
    mult = (rng.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    out = np.full((len(counts), n), 0xFFFFFFFF, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for rows, part in _chunks(counts):
        full = np.flatnonzero(counts[rows])
        if not len(full):
            continue
        begin = (np.cumsum(counts[rows]) - counts[rows])[full]
        px, work = x[part], np.empty(part.stop - part.start, dtype=np.uint32)
        got = np.empty((n, len(full)), dtype=np.uint32)
        for i in range(n):
            np.multiply(px, mult[i], out=work)
            np.minimum.reduceat(work, begin, out=got[i])
        out[rows.start + full] = got.T
    return out


def _chunks(counts: np.ndarray) -> Iterator[tuple[slice, slice]]:
    ends = np.cumsum(counts)
    first = at = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(ends, at + CHUNK, side="right")))
        yield slice(first, last), slice(at, int(ends[last - 1]))
        first, at = last, int(ends[last - 1])


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per run of `rows` values."""
    h = np.zeros((len(sig), sig.shape[1] // rows), dtype=np.uint64)
    for j in range(rows):
        h = h * _MIX + sig[:, j::rows][:, : h.shape[1]].astype(np.uint64) + np.uint64(1)
    return mix(h + np.arange(h.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019))
