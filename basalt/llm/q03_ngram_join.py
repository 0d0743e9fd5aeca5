"""Query op3: every document with its class of near duplicates and its number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .ngram_join import near_duplicates


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLES: dict[str, str] = {}
