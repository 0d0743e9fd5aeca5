"""Projections of one table: column expressions that Spark SQL and DuckDB read alike, so that a query and its SQL start
from the same rows. The rules themselves are written twice, as column expressions and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .projections import table


class View:
    def __init__(self, name: str, source: str, /, **columns: str):
        self.name, self.source, self.columns = name, source, columns

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"{self.name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {self.source})"


def cte(*views: View) -> str:
    return "WITH " + ", ".join(v.sql for v in views)


class Registry:
    """Queries of a module and their SQL."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def cases(key: str, *values: str) -> str:
    """A text by the remainder of key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
