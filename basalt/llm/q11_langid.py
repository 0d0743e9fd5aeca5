"""Query op11: the language of every text of documents, learnt from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .langid import identify, train


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang_pred is the nearest language whether it is rejected or not. A null id is neither held out nor learnt from."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    learnt = F.coalesce(fold != 2, F.lit(False))
    found = identify(docs, train(docs.where(learnt)), ["doc_id"], learnt)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


QUERIES = {"op11_langid": op11_langid}
ORACLES: dict[str, str] = {}
