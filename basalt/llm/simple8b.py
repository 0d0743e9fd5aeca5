"""Simple-8b: 64-bit words whose top four bits select how many ids of which width the other sixty hold.

A block is: magic 'S8B1', counts of documents, ids, words and escapes (uint32 each), the documents' lengths
(uint32), the words (uint64), the escapes (uint32); all little-endian. An id of ESCAPE or more stands as ESCAPE in
its slot, and its value in the escape list. Slots start at the low bits; the last word may be part full. Decoding
takes the words selector by selector, as matrices.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
#: Ids a word holds, and their bits, by selector. Fixed values of the format.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20)
ESCAPE = (1 << 20) - 1
_WIDTH16 = np.array([int(i).bit_length() for i in range(1 << 16)], dtype=np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    high = ids >> 16
    return np.where(high > 0, 16 + _WIDTH16[high], _WIDTH16[ids & 0xFFFF]).astype(np.uint8) if high.any() else _WIDTH16[ids]


def pack_words(ids: np.ndarray) -> np.ndarray:
    """ids: uint32 below or equal ESCAPE. Greedy: each word takes as many as fit."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype="<u8")
    most = {1: np.concatenate([_widths(ids), np.zeros(COUNTS[0], dtype=np.uint8)])}  # width of the widest of so many ids from each place
    choice = np.full(n, len(COUNTS) - 1, dtype=np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):  # wide to narrow, so that the narrowest that fits stays
        k = COUNTS[s]
        half = max(x for x in most if x < k)
        while 2 * half < k:
            most[2 * half] = np.maximum(most[half][:-half], most[half][half:])
            half *= 2
        most[k] = np.maximum(most[half][: half - k or None], most[half][k - half :])
        fits = most[k][:n] <= BITS[s]
        if s < len(COUNTS) - 1:
            if not fits.any():
                break
            choice[fits] = s
    step = np.asarray(COUNTS, dtype=np.uint8)[choice].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    begin = np.asarray(starts, dtype=np.int64)
    chosen = choice[begin]
    padded = np.concatenate([ids, np.zeros(COUNTS[0], dtype=ids.dtype)]).astype(np.uint64)
    words = np.empty(len(begin), dtype="<u8")
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        word = np.full(len(rows), s << 60, dtype=np.uint64)
        for k in range(COUNTS[s]):
            slot = padded[begin[rows] + k]
            word |= slot << np.uint64(k * BITS[s])
        words[rows] = word
    return words


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype="<u4")
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.asarray(COUNTS, dtype=np.int64)[chosen]
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype="<u4")
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        word, mask = words[rows], np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[begin[rows] + k] = (word >> np.uint64(k * BITS[s])) & mask
    return out[:n]


def encode_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """ids of several documents in a row, and how many each has."""
    ids = np.asarray(ids, dtype=np.uint32)
    wide = ids >= ESCAPE
    escapes = ids[wide].astype("<u4")
    words = pack_words(np.where(wide, np.uint32(ESCAPE), ids) if len(escapes) else ids)
    head = MAGIC + struct.pack("<4I", len(lengths), len(ids), len(words), len(escapes))
    return b"".join([head, np.asarray(lengths, dtype="<u4").tobytes(), words.tobytes(), escapes.tobytes()])


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n_docs, n_ids, n_words, n_escapes = struct.unpack("<4I", block[4:20])
    at = 20
    lengths = np.frombuffer(block, "<u4", n_docs, at)
    words = np.frombuffer(block, "<u8", n_words, at := at + 4 * n_docs)
    escapes = np.frombuffer(block, "<u4", n_escapes, at + 8 * n_words)
    ids = unpack_words(words, n_ids)
    if n_escapes:
        ids = ids.copy()
        ids[ids == ESCAPE] = escapes
    return ids, lengths
