"""Fuzzy line deduplication: one line of each group of near-equal lines stays in the whole collection.

Lines are '\\n'-split; blank ones (white space only) are never removed. Equal lines are one class. Lines whose
character-shingle signatures share a band with another's are found first; only these are sent again, with a sketch of
64 four-bit values. In each band, all pairs of members are then held against each other unless they are joined
already, and those that the sketch doesn't rule out are joined to loose groups by distributed union-find. Inside a
loose group every pair is compared by exact Jaccard similarity of its shingle sets, in blocks of bounded size, and what
is similar is joined by union-find again. Of each component the first line by (id, place) stays.

Bands: VALUES values in bands of r; a pair of similarity s shares one with chance 1 - (1 - s^r)^(VALUES / r), and r is the
greatest with which that is TARGET: 20 bands of 6 at 0.8 (0.9977), 30 of 4 at 0.65, 60 of 2 at 0.5. The sketch rules out a
pair of that similarity only if its share of equal values is five standard deviations below the expected one.
Nulls: a null text stays null. Rows may repeat: each is a document of its own, of equal ids the one with the lower text
hash comes first. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bitmap, deal, in_pairs, inside, unique_pairs
from .common import Stash, numbered, width
from .components import components
from .minhash import band_keys, signatures, windows
from .ngram_join import SLICE_CHARS, alike, exact_links, in_blocks, least_sketch
from .ngram_join import _nibbles as nibbles
from .ngram_join import _share as share
from .tokens import free_name, slices

SHINGLE, VALUES, TARGET, SIMILARITY = 5, 120, 0.997, 0.8
#: Whether a line has company is asked by the low half of its short id: a bitmap takes no more of it.
ENTRY = np.dtype([("key", "<u4"), ("id", "<u4")])
SKETCHED = np.dtype([("key", "<u4"), ("id", "<i8"), ("sketch", "V32")])
#: Entries that one task takes, about; entries with sketches; lines of small groups that a task compares; rows at once.
TASK_ENTRIES, SKETCHED_ENTRIES, TASK_LINES, CHUNK = 2_000_000, 500_000, 20_000, 1 << 16


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows of a band) that find a pair of this similarity with chance TARGET; an error if none do."""
    for rows in range(VALUES, 0, -1):
        bands = VALUES // rows
        if 1 - (1 - similarity**rows) ** bands >= TARGET:
            return bands, rows
    raise ValueError(f"{VALUES} values don't find lines of similarity {similarity} with chance {TARGET}")


def line_shingles(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return windows(codes, np.fromiter(map(len, lines), np.int64, len(lines)), k)


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Per line (UTF-8): the sorted distinct hashes of its shingles."""
    texts, out = [x.decode("utf-8", "surrogatepass") for x in lines], []
    for r in slices(texts, SLICE_CHARS):
        hashes, counts = line_shingles(texts[r.start : r.stop], SHINGLE)
        out += [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
    return out


def line_id(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()


def _short(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<i8")


def _distinct_lines(batch: pa.RecordBatch) -> Iterator[list[str]]:
    texts = batch.column(0).to_pylist()
    for r in slices(texts, SLICE_CHARS):
        lines = {line for i in r for line in (texts[i] or "").split("\n")}
        yield [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]


def in_company(texts: DataFrame, parts: int, similarity: float) -> DataFrame:
    """texts: one column. h: low halves of the short ids of lines that share a band with another line."""
    bands, rows = banding(similarity)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in _distinct_lines(batch):
                if not lines:
                    continue
                keys = band_keys(signatures(*line_shingles(lines, SHINGLE), bands * rows), rows)
                entries = np.empty(keys.size, dtype=ENTRY)
                entries["key"] = keys.ravel().astype(np.uint32)
                entries["id"] = np.repeat(_short([line_id(x) for x in lines]).astype(np.uint32), bands)
                cols = list(zip(*deal(keys.ravel(), entries, parts), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["part", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        e = in_pairs(table, ENTRY)
        key, ids = unique_pairs(e["key"], e["id"])
        same = key[1:] == key[:-1]
        met = np.zeros(len(key), dtype=bool)
        met[1:] |= same
        met[:-1] |= same
        return pa.table({"h": pa.array(np.unique(ids[met]).astype(np.int64))})

    return texts.mapInArrow(emit, "part int, blob binary").groupBy("part").applyInArrow(meet, "h long").distinct()


def lines_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, cls, line): the lines with these ids, and some others; cls is the whole digest."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(ids, "h"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in _distinct_lines(batch):
                if not lines:
                    continue
                digests = [line_id(x) for x in lines]
                short = _short(digests)
                hit = np.flatnonzero(inside(bits.value, short))
                yield pa.RecordBatch.from_arrays([pa.array(short[hit]), pa.array([digests[i] for i in hit], pa.binary()), pa.array([lines[i] for i in hit], pa.string())], names=["h", "cls", "line"])

    return texts.mapInArrow(fetch, "h long, cls binary, line string").groupBy("h", "cls").agg(F.first("line").alias("line"))


def loose_links(lines: DataFrame, parts: int, similarity: float) -> DataFrame:
    """lines: (h, line). (a, b): ids that a band joins: a spanning forest of its pairs that the sketch doesn't rule out."""
    (bands, rows), least = banding(similarity), least_sketch(similarity)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for r in slices(texts, SLICE_CHARS):
                sig = signatures(*line_shingles(texts[r.start : r.stop], SHINGLE), bands * rows)
                keys = band_keys(sig, rows)
                e = np.empty(keys.shape, dtype=SKETCHED)
                e["key"] = keys.astype(np.uint32)
                e["id"] = ids[r.start : r.stop, None]
                e["sketch"] = np.ascontiguousarray(nibbles(sig)).view("V32")
                cols = list(zip(*deal(keys.ravel(), e.ravel(), parts), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["part", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        e = in_pairs(table, SKETCHED)
        if not len(e):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        e = e[np.lexsort((e["id"], e["key"]))]
        new = np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["id"][1:] != e["id"][:-1])])
        e = e[new]
        sketch = np.frombuffer(e["sketch"].tobytes(), np.uint8).reshape(-1, 32)
        first = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
        sizes = np.diff(np.append(first, len(e)))
        root = np.repeat(first, sizes)
        far = np.concatenate([share(sketch[root[k : k + CHUNK]], sketch[k : k + CHUNK]) < least for k in range(0, len(e), CHUNK)])
        root[far] = np.flatnonzero(far)
        # where all are joined with the first one, or there are only two, nothing is left to meet
        for k in np.flatnonzero((np.add.reduceat(far, first, dtype=np.int64) > 0) & (sizes > 2)).tolist():
            lo, hi = int(first[k]), int(first[k] + sizes[k])
            root[lo:hi] = lo + alike(sketch[lo:hi], least)
        hit = np.flatnonzero(root != np.arange(len(e)))
        a, b = unique_pairs(e["id"][root[hit]], e["id"][hit])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return lines.select("h", "line").mapInArrow(emit, "part int, blob binary").groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def hashed(df: DataFrame) -> DataFrame:
    """df as the side of a join that is looked up: its keys are unique and its rows few in each partition, so the other
    side (texts, places of lines) is not sorted."""
    return df.hint("shuffle_hash")


def similar_lines(texts: DataFrame, entries: int, similarity: float, stash: Stash) -> DataFrame:
    """(a, b): digests; edges that span each component of lines that are that similar. entries: of the bands, about."""
    n, bands = width(texts.sparkSession), banding(similarity)[0]
    lines = stash.put(lines_of(texts, stash.put(in_company(texts, max(n, -(-entries // TASK_ENTRIES)), similarity), "company")), "lines")
    count = lines.count()
    groups = components(stash.put(loose_links(lines, max(n, -(-count * bands // SKETCHED_ENTRIES)), similarity), "loose"), stash)
    members = lines.join(hashed(groups.select(F.col("v").alias("h"), "root")), "h")
    members = stash.put(members.select("root", "cls", F.lit(1).alias("copies"), F.col("line").cast("binary").alias("shingles")), "members")
    linked = exact_links(in_blocks(members, 1, TASK_LINES), similarity, shingle_sets)
    return linked.select(F.col("cls").alias("a"), F.col("to").alias("b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, stash: Stash | None = None) -> DataFrame:
    """docs with the text that stays, and two columns more: removed (their places, from 0) and n_lines.

    Names that docs has already get an underscore.
    """
    spark = docs.sparkSession
    stash = stash or Stash(spark, "lines")
    removed, n_lines = free_name(docs, "removed"), free_name(docs, "n_lines")
    row = free_name(docs, "__row")
    rows = numbered(docs, row, stash)
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    whole = rows.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(row).alias("row"), F.split(text_col, "\n").alias("lines"))
    split = whole.select("id", "th", "row", F.posexplode("lines").alias("place", "line"))  # the text is hashed once, not for each line
    placed = stash.put(split.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select("id", "th", "row", "place", F.unhex(F.md5(F.col("line").cast("binary"))).alias("cls")), "places")
    comp = components(similar_lines(texts, placed.count() * banding(similarity)[0], similarity, stash), stash)
    classes = placed.groupBy("cls").agg(F.count("*").alias("n"))
    grouped = classes.join(hashed(comp), classes["cls"] == comp["v"], "left").where("n > 1 or root is not null").select("cls", F.coalesce("root", "cls").alias("root"))
    members = stash.put(placed.join(hashed(grouped), "cls").select("root", "id", "th", "row", "place"), "members")
    first = members.groupBy("root").agg(F.min(F.struct("id", "th", "row", "place")).alias("first")).select("root", F.col("first.row").alias("stay_row"), F.col("first.place").alias("stay_place"))
    gone = members.select("root", "row", "place").join(hashed(first), "root").where("row <> stay_row or place <> stay_place")
    places, flags = free_name(docs, "__places"), free_name(docs, "__flags")
    gone = gone.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list("place")).alias(places))
    # a flag per line up to the last that goes: looked up by place, where the list would be searched for each line
    before = F.slice(F.concat(F.array(F.lit(-1)), places), F.lit(1), F.size(places))
    up_to = F.zip_with(places, before, lambda p, q: F.concat(F.array_repeat(F.lit(False), p - q - 1), F.array(F.lit(True))))
    rows = rows.join(hashed(gone.withColumn(flags, F.flatten(up_to))), row, "left")
    lines = F.split(text_col, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(flags), i), F.lit(False))), "\n")
    text = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(left)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.coalesce(places, F.array().cast("array<int>")).alias(removed), F.coalesce(F.size(lines), F.lit(0)).alias(n_lines))
