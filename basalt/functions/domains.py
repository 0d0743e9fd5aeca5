"""Value domains of constraint variables, as data, and branch partitions of predicates, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundary values by type name, as Python literals. Fixed values.
BOUNDARIES = {
    "NoneType": ["None"],
    "bool": ["False", "True"],
    "int": ["-1", "0", "1", "2"],
    "float": ["-1.0", "0.0", "0.5", "1.0"],
    "str": ["''", "'x'", "'0'"],
    "bytes": ["b''", "b'x'"],
    "list": ["[]", "[0]", "[0, 1]"],
    "tuple": ["()", "(0,)", "(0, 1)"],
    "dict": ["{}", "{'k': 1}"],
    "set": ["set()", "{0}"],
    "Any": ["None", "False", "True", "-1", "0", "1", "''", "'x'", "[]", "[0]", "{}", "{'k': 1}"],
}


def default_values(domains: DataFrame) -> DataFrame:
    """domains: name, literals array<string>, types array<string>, lower long, upper long. Adds `vals`: the literals,
    the types' boundary values, then those next to the bounds; each once, in that order. Literals differ by type, so
    True and 1 stay two values."""
    table = F.create_map(*[x for t, v in BOUNDARIES.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in v]))])
    typed = F.flatten(F.transform("types", lambda t: F.coalesce(table[t], F.array().cast("array<string>"))))
    near = lambda c, d: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"), (F.col(c) + d).cast("string"))).otherwise(F.array().cast("array<string>"))
    return domains.withColumn("vals", F.array_distinct(F.concat("literals", typed, near("lower", 1), near("upper", -1))))


def branch_partitions(predicate: Column) -> Column:
    """The predicate, its negation, and what its truth or comparison divides values into; each once, in order."""
    e = F.when(F.trim(predicate) == "", "True").otherwise(F.trim(predicate))
    name = F.regexp_extract(e, "^(?:not\\s+)?([A-Za-z_]\\w*)$", 1)
    pattern = "^([A-Za-z_]\\w*)\\s*(<|<=|>|>=|==|!=)\\s*(-?\\d+(?:\\.\\d+)?)$"
    variable, bound = F.regexp_extract(e, pattern, 1), F.regexp_extract(e, pattern, 3)
    none = F.array().cast("array<string>")
    truth = F.array(F.format_string("len(%s) == 0", name), F.format_string("len(%s) > 0", name), F.format_string("bool(%s) is False", name), F.format_string("bool(%s) is True", name))
    sides = F.array(*[F.concat_ws(" ", variable, F.lit(op), bound) for op in ("<", "==", ">")])
    return F.array_distinct(F.concat(F.array(e, F.format_string("not (%s)", e)), F.when(name != "", truth).otherwise(none), F.when(variable != "", sides).otherwise(none)))
