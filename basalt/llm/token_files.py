"""Token files: documents in ascending id order, their ids as Simple-8b blocks, written and read by Spark.

A file is a Parquet part file of the container table; a row is a block (see simple8b) with its place. Part files
ascend with the ids, blocks inside a part ascend too. Spark's committer makes the files appear whole or not at all,
and any store that Spark writes to will do.

Nulls: a null text is an empty document (only the end id), a null id sorts first. Repeated ids stand side by side,
ordered by text hash and place of reading. An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import width
from .simple8b import decode_block, encode_block
from .tokens import fast_ids, slices

#: Ids a block holds before it is closed; a longer document is a block by itself.
BLOCK_IDS = 1 << 18


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("ids_before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["id", "tie", "row"]
    ranged = rows.repartitionByRange(parts or width(spark), *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, fast = TaskContext.get().partitionId(), fast_ids(path, "core")
        tail = np.uint32(end_id).astype("<u4").tobytes()
        block, before = 0, 0
        ids: list[pa.Array] = []
        blobs: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            lens = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
            payload = encode_block(np.frombuffer(b"".join(blobs), dtype="<u4"), lens)
            keys = pa.concat_arrays(ids)
            keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([int(lens.sum())]), keys, pa.array([payload], pa.binary())], names=schema.names)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for r in slices(texts):
                for i in r:
                    blob = fast(texts[i]) + tail
                    if blobs and size + len(blob) // 4 > BLOCK_IDS:
                        yield close()
                        block, before = block + 1, before + size
                        ids, blobs, size = [], [], 0
                    ids.append(batch.column(0).slice(i, 1))
                    blobs.append(blob)
                    size += len(blob) // 4
        if blobs:
            yield close()

    ranged.mapInArrow(run, schema).write.mode("errorifexists").option("compression", "uncompressed").parquet(out)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """The container table."""
    return spark.read.parquet(out)


def documents_of(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the blocks: id, start (ids of all before it), n_tokens, ids_crc32."""
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(id_col, id_type), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = decode_block(batch.column(3)[i].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py(), dtype=np.int32)), batch.column(2)[i].values, pa.array(starts + batch.column(1)[i].as_py()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=schema.names)

    docs = files.select("part", "ids_before", "doc_ids", "payload").mapInArrow(run, schema)
    # a row per part file, of which there are as many as the session has partitions
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"))
    return docs.join(F.broadcast(parts), "part").select(id_col, (F.col("at") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")
