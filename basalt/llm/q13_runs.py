"""Query op13: periodic runs of words in every text of documents, some of which are made periodic first."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .runs import find_runs


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: those of every tenth document repeat from place a on with period p. A null id changes
    nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return (words[:a] + block * (-(-(n - a) // p)))[:n]


def digests(found: DataFrame) -> DataFrame:
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.withColumn("top", longest)
    length = -F.col("top.l")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.s").alias("start"),
        length.alias("length"),
        F.col("top.p").alias("period"),
        F.expr("(-1000 * top.l) div top.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return digests(find_runs(table(spark, sf_dir, "documents"), "doc_id", rewrite=planted))


QUERIES = {"op13_runs": op13_runs}
ORACLES: dict[str, str] = {}
