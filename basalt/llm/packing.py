"""Best-fit packing by hierarchical residual packing.

1. Items (whole documents; only longer ones cut) are packed best-fit-decreasing inside each partition.
2. Bins with at most `slack` free tokens are final and leave. The underfull ones become items themselves.
3. Underfull bins of several partitions meet in one, where best fit merges them; this repeats with ever fewer
   partitions until one bounded task holds them all, or until a round no longer saves bins.

A bin never holds more than `capacity` items (each has a token at least), so a row is bounded, and a task never
holds more than `task_bins` bins. Rounds are written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash, width
from .tokens import fast_ids, slices

#: Free tokens with which a bin is nearly full and leaves: fewer than the least common document has.
SLACK = 8
BIN = "size int, items array<struct<row:bigint,length:int>>"
PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def tokenised_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id column, piece, start, length, ids_crc32. Null text counts as empty: just the end id.

    A document of n > capacity tokens is cut from its end, so that its first piece is the short one.
    """
    schema = T.StructType([docs.schema[id_col], *PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = fast_ids(path, "core")
        tail = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                at, rows = [], []
                for i in part:
                    blob = fast(texts[i]) + tail
                    n = len(blob) // 4
                    start, end = 0, n % capacity or capacity
                    k = 0
                    while start < n:
                        rows.append((k, start, end - start, zlib.crc32(blob[4 * start : 4 * end])))
                        at.append(i)
                        start, end, k = end, end + capacity, k + 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, f) for c, f in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by bin. A bit of `free` says that a bin with so much room is open."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    free = 0
    for i in order:
        size = sizes[i]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free ^= 1 << left
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= size
        if left:
            room[left].append(b)
            free |= 1 << left
    return bins


def _merge(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        sizes = t.column("size").to_pylist()
        items = t.column("items").combine_chunks()
        if isinstance(items, pa.ChunkedArray):
            items = pa.concat_arrays(items.chunks)
        offsets = items.offsets.to_numpy()
        bins = best_fit(sizes, capacity)
        for k in range(0, len(bins), 5000):
            part = bins[k : k + 5000]
            take = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for b in part for i in b])
            lens = [sum(int(offsets[i + 1] - offsets[i]) for i in b) for b in part]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), items.values.take(pa.array(take)))
            yield pa.RecordBatch.from_arrays([pa.array([sum(sizes[i] for i in b) for b in part], pa.int32()), lists], names=["size", "items"])

    return run


def pack(items: DataFrame, capacity: int, slack: int = SLACK, task_bins: int = 200_000, fan_in: int = 8, least_gain: float = 0.002, stash: Stash | None = None) -> DataFrame:
    """items: columns row (unique) and length in 1..capacity. Returns row, sequence_id, offset.

    Ties are broken freely; an empty table gives an empty one.
    """
    spark = items.sparkSession
    stash = stash or Stash(spark, "pack")
    single = items.select(F.col("length").cast("int").alias("size"), F.array(F.struct(F.col("row"), F.col("length").cast("int").alias("length"))).alias("items"))
    n = items.count()
    parts = max(1, min(width(spark), -(-n // 20_000)), -(-n // task_bins))
    done: list[DataFrame] = []
    level, open_bins, path = 0, single.where(F.col("size") < capacity), None
    full = single.where(F.col("size") == capacity)
    while True:
        merged, new_path = stash.write(_grouped(open_bins, parts, level).mapInArrow(_merge(capacity), BIN), f"level{level}")
        before, after = n, merged.agg(F.count("*"), F.sum((F.col("size") < capacity - slack).cast("long"))).first()
        made, rest = after[0], after[1] or 0
        done.append(merged.where(F.col("size") >= capacity - slack))
        last = parts == 1 or not rest or (level and made > before * (1 - least_gain))
        if last:
            done.append(merged.where(F.col("size") < capacity - slack))
            break
        open_bins, path, n = merged.where(F.col("size") < capacity - slack), new_path, rest
        parts = max(1, -(-parts // fan_in), -(-n // task_bins)) if n > 20_000 else 1
        level += 1
    out = full
    for d in done:
        out = out.unionByName(d)
    numbered = out.withColumn("sequence_id", F.monotonically_increasing_id())
    # numbered once and written: a task run again must not number anew
    numbered = stash.put(numbered, "bins")
    ends = F.aggregate("items", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")), lambda a: a["starts"])
    return numbered.select("sequence_id", F.explode(F.arrays_zip("items", ends.alias("at"))).alias("x")).select(F.col("x.items.row").alias("row"), "sequence_id", F.col("x.at").cast("long").alias("offset"))


def _grouped(df: DataFrame, parts: int, level: int) -> DataFrame:
    if parts == 1:
        return df.coalesce(1) if level else df.repartition(1)
    return df.repartition(parts, F.xxhash64(F.col("items")[0]["row"], F.lit(level)))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Pieces of all documents with their place: id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls in any column, repeated ids and repeated texts are ordinary rows; every row is packed.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "pack")
    pieces = tokenised_pieces(docs, path, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    pieces = stash.put(pieces, "pieces")
    placed = pack(pieces.select("row", "length"), capacity, stash=stash, **how)
    return pieces.join(placed, "row").drop("row")
