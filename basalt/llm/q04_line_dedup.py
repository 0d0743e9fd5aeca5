"""Query op4: all documents without the lines that say what another line says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import ship, table
from .line_dedup import dedup_lines


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES: dict[str, str] = {}
