"""Every query of the library outside the training-data operators, with the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["graph_queries", "check_queries", "trace_queries", "domain_queries", "gate_queries", "oracle_queries", "trial_queries", "challenge_queries", "requirement_queries", "text_queries", "binding_queries", "path_queries", "solver_queries", "trajectory_queries", "program_queries", "slice_queries", "search_queries", "cut_queries", "ledger_queries"]


def modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in modules() for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["graph_reach"](spark, sf_dir)
