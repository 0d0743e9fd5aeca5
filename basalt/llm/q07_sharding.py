"""Query op7: all documents into forty shards whose counts are at most one apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_or_empty
from .sharding import assign

SHARDS, VNODES, ROW_BYTES = 40, 64, 16


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    out = assign(docs, SHARDS, "doc_id", VNODES, 1.0, ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
