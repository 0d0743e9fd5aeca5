"""Moving many small hash entries as a few binary rows, and sets of 64-bit ids as bitmaps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 8 MB at most, whatever the number of ids. More ids only make it let more rows through.
BITS = 1 << 26


def deal(keys: np.ndarray, entries: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, entries' bytes) by key; entries is a structured array."""
    to = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, entries = to[order], entries[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(to)]]), strict=True):
        if hi > lo:
            yield int(to[lo]), entries[lo:hi].tobytes()


def chunks(table: pa.Table, dtype: np.dtype) -> list[np.ndarray]:
    """The entries of each chunk of the column blob, without a copy."""
    out = []
    for c in table.column("blob").chunks:
        _, offsets, data = c.buffers()
        if data is not None and len(c):
            at = np.frombuffer(offsets, np.int32, len(c) + 1, 4 * c.offset)
            out.append(np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])).view(dtype))
    return out


def in_pairs(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    """The entries whose key stands in another entry, too. Only the keys of all of them are laid out and sorted."""
    parts = chunks(table, dtype)
    keys = np.concatenate([p["key"] for p in parts]) if parts else np.zeros(0, dtype["key"])
    keys.sort()
    twice = keys[1:][keys[1:] == keys[:-1]]
    del keys
    if not len(twice):
        return np.zeros(0, dtype)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    kept = []
    for p in parts:
        key = np.ascontiguousarray(p["key"])
        kept.append(p[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key])
    return np.concatenate(kept)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, b), sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return a[keep], b[keep]


def bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """The ids' bits, as uint64 words; a row per word at most comes to the driver."""
    bit = ids.select(F.pmod(F.col(col), F.lit(BITS)).alias("p"))
    words = bit.select(F.expr("cast(shiftright(p, 6) as int)").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BITS // 64, dtype=np.uint64)
    t = words.toArrow()
    if t.num_rows:
        out[t.column("w").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return out


def inside(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """ids: int64. May say yes to others, never no to one of the set."""
    at = np.mod(ids, BITS).astype(np.uint64)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
