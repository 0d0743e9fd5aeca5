"""Round tables of iterative operators: written to the folder in spark.checkpoint.dir, so lineage stays short."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


#: Shuffle files of a query go when it ends, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_basalt_rounds", None)
    if not where:
        where = tempfile.mkdtemp(prefix="basalt-rounds-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext._basalt_rounds = where
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        pass


class Rounds:
    """Tables of one run of an operator; they go when the interpreter ends, since results may still read them."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{folder(spark)}/{tag}-{uuid.uuid4().hex}", 0
        atexit.register(_delete, spark, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        """The table, written. Shuffle files of its own go once it is there, as nothing reads them again."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        was = self.spark.conf.get(_CLEANUP, None)
        try:
            self.spark.conf.set(_CLEANUP, "true")
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if was is None else self.spark.conf.set(_CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def part(self, tag: str) -> Rounds:
        """Tables of a step, to be cleared once what it leads to is put here."""
        return Rounds(self.spark, tag)

    def clear(self) -> None:
        """Delete all tables so far: nothing that is still to be read may rest on them."""
        _delete(self.spark, self.root)

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The table and its rows, counted by the write itself. Tasks that run again may count twice, so only 0 and not 0
        are certain."""
        rows = Observation()
        table = self.put(df.observe(rows, F.count(F.lit(1)).alias("n")))
        return table, rows.get["n"]


def ranked(df: DataFrame, order: list[Column], name: str, rounds: Rounds) -> DataFrame:
    """df with the place of each row (from 1) in the order of all rows, without one task that sees them all: ranges of the
    order are numbered inside, and start where the counts of the ranges before them end."""
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inside = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    numbered = inside.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    fixed = rounds.put(numbered)
    counts = fixed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return fixed.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__at") + 1).cast("int")).drop("__part", "__at", "__start")
