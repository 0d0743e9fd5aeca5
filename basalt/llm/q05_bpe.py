"""Query op5: every whole text of documents through the transducer and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .tokens import transcode


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(transcode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"]))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
