"""JSON and JSON-lines sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INSTANCE = "instance_id string, repository string, base_commit string, issue string, visible_tests array<string>, public_metadata map<string,string>, environment map<string,string>"


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file; what can't be parsed becomes a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True)


def load_instance(spark: SparkSession, path: str) -> DataFrame:
    return read_object(spark, path, INSTANCE)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


RUN_MANIFEST = "run_id string, instance_id string, schema_version string, config map<string,string>, started_at string"


def load_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_object(spark, path, RUN_MANIFEST)


def write_object(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON file in the folder `path`; more rows are refused."""
    if len(row.take(2)) != 1:
        raise ValueError("one row makes one object")
    row.coalesce(1).write.mode("overwrite").json(path)
