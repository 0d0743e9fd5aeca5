"""Queries over literal fixtures of the value tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domains as dm

QUERIES, ORACLES = {}, {}

_PREDICATES = [(0, "x"), (1, "not y"), (2, "n <= 3"), (3, "n == 3"), (4, ""), (5, "f(x) > 1")]
_PARTS = [
    (0, ["x", "not (x)", "len(x) == 0", "len(x) > 0", "bool(x) is False", "bool(x) is True"]),
    (1, ["not y", "not (not y)", "len(y) == 0", "len(y) > 0", "bool(y) is False", "bool(y) is True"]),
    (2, ["n <= 3", "not (n <= 3)", "n < 3", "n == 3", "n > 3"]),
    (3, ["n == 3", "not (n == 3)", "n < 3", "n > 3"]),
    (4, ["True", "not (True)", "len(True) == 0", "len(True) > 0", "bool(True) is False", "bool(True) is True"]),
    (5, ["f(x) > 1", "not (f(x) > 1)"]),
]


def branch_partition_constraints(spark, sf_dir):
    rows = spark.createDataFrame(_PREDICATES, "id int, predicate string")
    return rows.select("id", F.posexplode(dm.branch_partitions(F.col("predicate"))).alias("place", "part"))


def default_domain_values(spark, sf_dir):
    rows = spark.createDataFrame([(0, ["7"], ["int", "bool"], None, None), (1, [], ["unknown"], 3, 9), (2, ["1", "True"], ["NoneType"], 1, None)], "id int, literals array<string>, types array<string>, lower long, upper long")
    return dm.default_values(rows).select("id", F.posexplode("vals").alias("place", "value"))


_VALUES = [(0, ["7", "-1", "0", "1", "2", "False", "True"]), (1, ["3", "4", "9", "8"]), (2, ["1", "True", "None", "2"])]
_sql = lambda rows, name: f"SELECT * FROM (VALUES {', '.join(f'({i}, {k}, ' + chr(39) + v + chr(39) + ')' for i, vs in rows for k, v in enumerate(vs))}) v(id, place, {name})"

QUERIES |= {"branch_partition_constraints": branch_partition_constraints, "default_domain_values": default_domain_values}
ORACLES |= {"branch_partition_constraints": _sql(_PARTS, "part"), "default_domain_values": _sql(_VALUES, "value")}
