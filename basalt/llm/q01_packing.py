"""Query op1: all documents into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .packing import pack_documents

CAPACITY, END_ID = 2048, 0


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
