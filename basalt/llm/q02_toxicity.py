"""Query op2: a toxicity score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .toxicity import held_out, train


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "hits")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
