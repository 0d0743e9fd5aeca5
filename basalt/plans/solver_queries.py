"""Queries over constraints: small searches, one for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import solve as sv
from .views import Registry, View, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

PROBLEMS = View("problems", "part", id="p_partkey", k="p_size % 4", closed="p_partkey % 2 = 0", odd="p_partkey % 11 = 0", lost="p_partkey % 13 = 0")


def _problem(spark, sf_dir):
    """x is an int of -1, 0, 1, 2, y a bool; constraints: x > k, and y."""
    p = PROBLEMS.frame(spark, sf_dir)
    none, text = F.lit(None).cast("long"), F.array().cast("array<string>")
    domain = lambda name, kind: F.struct(F.lit(name).alias("domain"), text.alias("literals"), F.array(F.lit(kind)).alias("types"), none.alias("lower"), none.alias("upper"), (~F.col("closed")).alias("is_open"))
    variable = lambda name, d: F.struct(F.lit(name).alias("name"), d.alias("domain"))
    limit = F.concat(F.lit("x > "), F.col("k").cast("string"))
    return p.select("id", "k", "lost", F.array(variable("x", F.when(F.col("lost"), "dz").otherwise("dx")), variable("y", F.lit("dy"))).alias("variables"), F.array(domain("dx", "int"), domain("dy", "bool")).alias("domains"), F.array(F.when(F.col("odd"), F.concat(limit, F.lit(" + 1"))).otherwise(limit), F.lit("y")).alias("constraints"))


@query(cte(PROBLEMS) + """ SELECT id, CASE WHEN odd THEN 'unsupported_constraint:unsupported constraint syntax: BinOp' WHEN lost THEN 'missing_domain:dz' WHEN k < 2 THEN 'finite_domain_witness' WHEN closed THEN 'finite_domain_exhausted' ELSE 'open_world_unresolved' END AS reason,
  NOT odd AND NOT lost AND k < 2 AS satisfiable, CASE WHEN NOT odd AND NOT lost AND k < 2 THEN 'x=' || (k + 1) || ';y=True' END AS witness, CAST(CASE WHEN odd OR lost THEN 0 WHEN k < 2 THEN 2 * (k + 2) + 2 ELSE 8 END AS BIGINT) AS tried, odd OR lost OR k < 2 OR closed AS complete FROM problems""")
def solve_constraints(spark, sf_dir):
    return sv.solve_constraints(_problem(spark, sf_dir), "id")


@query(cte(PROBLEMS) + """ SELECT id, NOT odd AS feasible, CASE WHEN odd THEN 'syntactic_contradiction' WHEN lost THEN 'UNKNOWN_OPEN_WORLD:open_world_unresolved' WHEN k = 0 THEN 'finite_domain_witness' ELSE 'UNKNOWN_OPEN_WORLD:open_world_unresolved' END AS reason FROM problems""")
def guard_feasibility(spark, sf_dir):
    """Values of any type: x > 0 holds for 1 and True, x > 1 for none. Type names in a guard are variables, too, so that
    isinstance has no witness either."""
    k = F.col("k").cast("string")
    guards = F.array(F.lit("entry"), F.concat(F.lit("x > "), k), F.when(F.col("odd"), F.concat(F.lit("not (x > "), k, F.lit(")"))).otherwise("loop_back"), F.when(F.col("lost"), "x is None").when(F.col("k") == 1, "isinstance(x, int)").otherwise("raises(KeyError)"))
    return sv.guard_feasibility(PROBLEMS.frame(spark, sf_dir).select("id", guards.alias("guards")), "id")


_FORMULA = """concat(CASE p_partkey % 4 WHEN 0 THEN 'isinstance(x, int) and x > 3' WHEN 1 THEN 'an empty y' WHEN 2 THEN 'x is not None' ELSE 'plain' END, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' "7" "ab"' ELSE ' "ab"' END)"""
FORMULAS = View("formulas", "part", id="p_partkey", formula=_FORMULA)


@query("""WITH f AS (SELECT p_partkey AS id, p_partkey % 4 AS m, CASE p_size % 3 WHEN 1 THEN '7;''ab''' WHEN 2 THEN '''ab''' ELSE '' END AS literals FROM part)
SELECT id, name, CASE WHEN m = 1 THEN 'list,str,tuple' WHEN m = 0 AND name = 'x' THEN 'int' WHEN m = 2 AND name = 'x' THEN 'NoneType' ELSE 'Any' END AS types, literals FROM f, (VALUES ('x'), ('y')) v(name)""")
def infer_domains(spark, sf_dir):
    return sv.infer_domains(FORMULAS.frame(spark, sf_dir).withColumn("names", F.array(F.lit("x"), F.lit("y"))), "id")


@query(cte(PROBLEMS) + " SELECT id, CASE WHEN odd THEN 'a,c,len,rows' ELSE 'd,len,rows' END AS names FROM problems")
def predicate_names(spark, sf_dir):
    preds = F.array(F.concat(F.lit("len(rows) > "), F.col("k").cast("string")), F.when(F.col("odd"), "a.b < c[0]").otherwise("not d"), F.when(F.col("lost"), "x ==").otherwise("True"))
    return sv.predicate_names(PROBLEMS.frame(spark, sf_dir).select("id", preds.alias("predicates")), "id").withColumn("names", F.array_join("names", ","))


@query(cte(PROBLEMS) + " SELECT id, NOT lost AND NOT odd AS is_expression FROM problems")
def precondition_expressions(spark, sf_dir):
    text = F.when(F.col("lost"), "the list is").when(~F.col("odd"), F.concat(F.lit("x > "), F.col("k").cast("string")))
    return sv.preconditions(PROBLEMS.frame(spark, sf_dir).select("id", text.alias("condition")), "id")


_HITS = "CASE c WHEN 'ge' THEN k <= 2 WHEN 'lt' THEN true WHEN 'eq' THEN k <= 2 WHEN 'gt' THEN k < 2 ELSE true END"


@query(cte(PROBLEMS) + f""", c AS (SELECT id, k, closed, id % 3 = 0 AS has FROM problems WHERE NOT lost),
p AS (SELECT id, k, closed, CAST(0 AS INTEGER) AS place, 'y' AS c, 'y' AS text FROM c WHERE has UNION ALL SELECT id, k, closed, CAST(n + CASE WHEN has THEN 1 ELSE 0 END AS INTEGER), c, replace(text, '#', CAST(k AS VARCHAR)) FROM c, (VALUES (0, 'ge', 'x >= #'), (1, 'not', 'not (x >= #)'), (2, 'lt', 'x < #'), (3, 'eq', 'x == #'), (4, 'gt', 'x > #')) v(n, c, text))
SELECT id, place, text AS "constraint", {_HITS} AS satisfiable, CASE WHEN {_HITS} THEN 'finite_domain_witness' WHEN closed THEN 'finite_domain_exhausted' ELSE 'open_world_unresolved' END AS reason, {_HITS} OR closed AS complete, closed AS covers FROM p""")
def scenario_partitions(spark, sf_dir):
    rows = _problem(spark, sf_dir).where("not lost").select("id", "variables", "domains", F.when(F.col("id") % 3 == 0, "y").otherwise("True").alias("precondition"), F.array(F.concat(F.lit("x >= "), F.col("k").cast("string"))).alias("guards"))
    return sv.scenario_partitions(rows, "id").drop("witness")


EXPECTATIONS = View("expectations", "part", id="p_partkey", formula="concat(CASE p_partkey % 6 WHEN 0 THEN concat('f(x) returns ', CAST(p_size AS STRING), ' for every x') WHEN 1 THEN concat('Expected result is [', CAST(p_size AS STRING), ', ''a'']') WHEN 2 THEN 'it returns None.' WHEN 3 THEN concat('assert run(1) == (', CAST(p_size AS STRING), ',)') WHEN 4 THEN 'returns the list' ELSE 'nothing said' END, '')")


@query(cte(EXPECTATIONS) + """, s AS (SELECT id, id % 6 AS m, regexp_extract(formula, '[0-9]+(?:[^0-9]*$)') AS tail, CASE id % 6 WHEN 0 THEN regexp_extract(formula, 'returns ([0-9]+)', 1) WHEN 1 THEN regexp_extract(formula, '\\[([0-9]+)', 1) ELSE regexp_extract(formula, '\\(([0-9]+),', 1) END AS n FROM expectations)
SELECT id, m < 4 AS found, CASE m WHEN 0 THEN n WHEN 1 THEN '{"items":[' || n || ',"a"],"length":2,"type":"list"}' WHEN 2 THEN 'null' WHEN 3 THEN '{"items":[' || n || '],"length":1,"type":"tuple"}' END AS expected FROM s""")
def expected_values(spark, sf_dir):
    return sv.expected_values(EXPECTATIONS.frame(spark, sf_dir), "id")
