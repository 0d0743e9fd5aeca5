"""Queries over paired checks and unit outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions as d
from ..operators.requirements import unresolved_rows
from .projections import OUT, RUNS, check_runs, outcomes, table
from .views import View, cte

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sides(spark, sf_dir):
    runs = check_runs(spark, sf_dir)
    return runs.where("side = 'BASE'"), runs.where("side = 'PATCH'")


def _compared(spark, sf_dir):
    return d.compare_checks(*_sides(spark, sf_dir), "check_id")


@query(f"WITH {RUNS} SELECT check_id, role, baseline, patched, class FROM compared")
def check_comparison(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"WITH {RUNS} SELECT role, class, count(*) AS n FROM compared GROUP BY role, class")
def check_classification_counts(spark, sf_dir):
    return _compared(spark, sf_dir).groupBy("role", "class").agg(F.count("*").alias("n"))


_VECTOR = """count(*) FILTER (class = 'TARGET_FIXED') AS fixed, count(*) FILTER (class IN ('TARGET_REGRESSED', 'PRESERVATION_REGRESSION')) AS regressed,
 count(*) FILTER (class = 'TARGET_STILL_FAILING') AS still_failing, count(*) FILTER (class = 'PASS_PRESERVED') AS preserved,
 count(*) FILTER (class IN ('FLAKY_RESULT', 'SAME_INFRA_FAILURE', 'NEW_INFRA_FAILURE', 'UNSUPPORTED_CHECK')) AS unknown"""


@query(f"WITH {RUNS} SELECT role, {_VECTOR} FROM compared GROUP BY role")
def progress_vector(spark, sf_dir):
    return d.progress_vector(_compared(spark, sf_dir), ["role"])


@query(f"WITH {RUNS} SELECT check_id, role FROM compared WHERE class IN ('TARGET_REGRESSED', 'PRESERVATION_REGRESSION')")
def confirmed_failures(spark, sf_dir):
    return _compared(spark, sf_dir).where(F.col("class").isin("TARGET_REGRESSED", "PRESERVATION_REGRESSION")).select("check_id", "role")


@query(f"WITH {RUNS} SELECT segment, CASE status WHEN 'PASS' THEN 'passed' WHEN 'FAIL' THEN 'failed' ELSE 'unknown' END AS part, count(*) AS n FROM runs WHERE side = 'PATCH' GROUP BY ALL")
def state_information(spark, sf_dir):
    return _sides(spark, sf_dir)[1].groupBy("segment", d.partition_of(F.col("status")).alias("part")).agg(F.count("*").alias("n"))


_TIERS = [("llm_reproduction", None, "PUBLIC", "x"), ("serialization_or_rendering", None, "A", ""), ("other", "d", "A", ""), ("other", None, "b", ""), ("other", None, "PUBLIC", ""), ("other", None, "?", "Issue-Behavior 3"), ("other", None, None, "z"), ("issue_executable_witness", None, None, None)]


@query("SELECT * FROM (VALUES (0, 'E'), (1, 'C'), (2, 'D'), (3, 'B'), (4, 'A'), (5, 'B'), (6, 'E'), (7, 'B')) v(id, tier)")
def authority_tier(spark, sf_dir):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_TIERS)], "id int, strategy string, candidate string, authority string, evidence string")
    return rows.select("id", d.authority_tier(*[F.col(c) for c in ("strategy", "candidate", "authority", "evidence")]).alias("tier"))


@query(f"""WITH {OUT}, u AS (SELECT o_orderkey AS unit, o_custkey AS requirement, o_totalprice AS weight FROM orders WHERE o_orderpriority <> '5-LOW'),
s AS (SELECT unit, bool_or(kind = 'TARGET' AND status <> 'PASS') AS bad FROM outcome GROUP BY unit)
SELECT requirement, round(sum(CASE WHEN s.unit IS NULL OR bad THEN weight ELSE 0 END), 2) AS deficit FROM u LEFT JOIN s USING (unit) GROUP BY requirement""")
def target_deficit(spark, sf_dir):
    """Weight of target units without an outcome of any kind, or with a TARGET outcome that isn't a pass."""
    units = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("requirement"), F.col("o_totalprice").alias("w"))
    seen = outcomes(spark, sf_dir).groupBy("unit").agg(F.bool_or((F.col("kind") == "TARGET") & (F.col("status") != "PASS")).alias("bad"))
    lost = F.when(F.coalesce("bad", F.lit(True)), F.col("w")).otherwise(0.0)
    return units.join(seen, "unit", "left").groupBy("requirement").agg(F.round(F.sum(lost), 2).alias("deficit"))


@query(f"""WITH {OUT}, side AS (SELECT path, kind, bool_and(status = 'PASS') AS ok FROM outcome GROUP BY path, kind)
SELECT b.path FROM side b JOIN side a USING (path) WHERE b.kind = 'PRESERVATION' AND NOT b.ok AND a.kind = 'TARGET' AND a.ok""")
def repaired_paths(spark, sf_dir):
    """Paths that lose before (kind PRESERVATION stands for before) and pass everywhere after."""
    ok = outcomes(spark, sf_dir).groupBy("path", "kind").agg(F.every(F.col("status") == "PASS").alias("ok"))
    return ok.where("kind = 'PRESERVATION' and not ok").select("path").join(ok.where("kind = 'TARGET' and ok").select("path"), "path")


UNITS = View("units", "lineitem", requirement="l_orderkey", unit="l_partkey", status="CASE WHEN l_orderkey % 3 = 0 THEN 'PASSING' WHEN l_orderkey % 3 = 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'ORACLE_UNAVAILABLE' ELSE 'ENVIRONMENT_BLOCKED' END WHEN l_partkey % 19 = 0 THEN 'PRESERVATION_RISK' WHEN l_partkey % 17 = 0 THEN 'FAILING' WHEN l_partkey % 13 = 0 THEN 'COUNTEREXAMPLE_OPEN' WHEN l_partkey % 11 = 0 THEN 'UNBOUND' ELSE 'PASSING' END")
MORE = View("more", "orders", requirement="o_orderkey", unit="0", status="CASE o_orderstatus WHEN 'F' THEN 'UNKNOWN' ELSE 'PASSING' END", has="o_orderkey % 4 = 1")
_COVERED = cte(UNITS, MORE) + """, s AS (SELECT requirement, list(DISTINCT status) AS st FROM (SELECT requirement, status FROM units UNION ALL SELECT requirement, status FROM more WHERE has) GROUP BY requirement),
covered AS (SELECT requirement, CASE WHEN list_contains(st, 'PRESERVATION_RISK') THEN 'PRESERVATION_RISK' WHEN list_has_any(st, ['FAILING', 'COUNTEREXAMPLE_OPEN']) THEN 'FAILING' WHEN st = ['PASSING'] THEN 'PASSING'
  WHEN list_contains(st, 'UNBOUND') THEN 'UNBOUND' WHEN len(list_filter(st, lambda x: x NOT IN ('ORACLE_UNAVAILABLE', 'ENVIRONMENT_BLOCKED'))) = 0 THEN 'UNTESTABLE' ELSE 'UNKNOWN' END AS status FROM s)"""


@query(_COVERED + " SELECT requirement, status FROM covered")
def requirement_coverage(spark, sf_dir):
    units = UNITS.frame(spark, sf_dir).unionByName(MORE.frame(spark, sf_dir).where("has").drop("has"))
    return units.groupBy("requirement").agg(F.collect_set("status").alias("st")).select("requirement", d.coverage_status(F.col("st")).alias("status"))


@query(_COVERED + " SELECT requirement, status FROM covered WHERE status <> 'PASSING'")
def unresolved_requirements(spark, sf_dir):
    return unresolved_rows(requirement_coverage(spark, sf_dir))


@query(f"WITH {OUT} SELECT component, round(sum(CASE WHEN status = 'PASS' THEN weight ELSE 0 END) / sum(weight), 6) AS ratio FROM outcome GROUP BY component")
def path_closure_ratio(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("component").agg(F.round(F.sum(F.when(F.col("status") == "PASS", F.col("weight")).otherwise(0.0)) / F.sum("weight"), 6).alias("ratio"))


@query("SELECT o_orderkey AS unit FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def binding_closure_missing(spark, sf_dir):
    bound = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit")).join(bound, "unit", "left_anti")


@query("SELECT l_orderkey AS unit, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def binding_closure_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {OUT} SELECT unit FROM outcome GROUP BY unit HAVING count(DISTINCT path) = count(DISTINCT CASE WHEN status = 'PASS' THEN path END) AND bool_and(status = 'PASS')")
def component_shadow_pass(spark, sf_dir):
    """Relational division: units all of whose paths are seen and pass."""
    passed = F.when(F.col("status") == "PASS", F.col("path"))
    sums = outcomes(spark, sf_dir).groupBy("unit").agg(F.countDistinct("path").alias("need"), F.countDistinct(passed).alias("have"), F.every(F.col("status") == "PASS").alias("ok"))
    return sums.where("need = have and ok").select("unit")


@query(f"WITH {OUT} SELECT component, count(*) AS n, count(*) FILTER (status = 'PASS') AS passed, round(count(*) FILTER (status = 'PASS') / count(*), 6) AS ratio, count(*) FILTER (status = 'PASS') * 3 > count(*) AS effective FROM outcome GROUP BY component")
def component_effectiveness(spark, sf_dir):
    n, ok = F.count("*"), F.count_if(F.col("status") == "PASS")
    return outcomes(spark, sf_dir).groupBy("component").agg(n.alias("n"), ok.alias("passed"), F.round(ok / n, 6).alias("ratio"), (ok * 3 > n).alias("effective"))


@query(f"""WITH {OUT}, u AS (SELECT o_orderkey AS unit, o_custkey AS component, CAST(1 + o_orderkey % 3 AS DOUBLE) AS weight, o_orderkey % 2 AS bypasses, o_orderkey % 5 AS frontiers FROM orders),
w AS (SELECT unit, max(CASE status WHEN 'FAIL' THEN 4.0 WHEN 'UNKNOWN' THEN 2.5 ELSE 1.0 END) AS worst, bool_and(status = 'PASS') AS ok FROM outcome GROUP BY unit),
p AS (SELECT component, round(sum(weight + coalesce(worst, 3) + 0.5 * bypasses + 0.75 * frontiers), 6) AS pressure, count(*) AS units FROM u LEFT JOIN w USING (unit) WHERE ok IS NULL OR NOT ok GROUP BY component)
SELECT component, pressure, units FROM p ORDER BY pressure DESC, component DESC LIMIT 1""")
def losing_core(spark, sf_dir):
    """The component under most pressure; of equal ones the greatest id."""
    key = F.col("o_orderkey")
    units = table(spark, sf_dir, "orders").select(key.alias("unit"), F.col("o_custkey").alias("component"), (1 + key % 3).cast("double").alias("weight"), (key % 2).alias("bypasses"), (key % 5).alias("frontiers"))
    return d.losing_components(units, outcomes(spark, sf_dir)).orderBy(F.desc("pressure"), F.desc("component")).limit(1)


@query(f"WITH {OUT} SELECT kind, status, count(*) AS n, sum(weight) AS weight FROM outcome GROUP BY kind, status")
def outcome_histogram(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


_SCORE = "round(weight * CASE status WHEN 'FAIL' THEN 3.0 WHEN 'UNKNOWN' THEN 2.0 ELSE 1.0 END * CASE kind WHEN 'TARGET' THEN 2.0 ELSE 1.0 END / greatest(CAST(path % 7 AS DOUBLE), 0.1), 6)"


@query(f"WITH {OUT}, c AS (SELECT DISTINCT unit, path, {_SCORE} AS score FROM outcome) SELECT unit, path, score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, path) AS r FROM c) WHERE r = 1")
def top_challenges_per_unit(spark, sf_dir):
    risk = F.when(F.col("status") == "FAIL", 3.0).when(F.col("status") == "UNKNOWN", 2.0).otherwise(1.0)
    gain = F.when(F.col("kind") == "TARGET", 2.0).otherwise(1.0)
    score = F.round(d.challenge_score(F.col("weight"), risk, gain, F.lit(1.0), (F.col("path") % 7).cast("double")), 6)
    cells = outcomes(spark, sf_dir).select("unit", "path", score.alias("score"))
    return cells.groupBy("unit").agg(F.max_by(F.struct("path", "score"), F.struct("score", -F.col("path"))).alias("x")).select("unit", "x.path", "x.score")


@query("""SELECT coalesce(g.seg, h.seg) AS instance, coalesce(g.state, 'NOT_GENERATED') AS generation, coalesce(h.state, 'NOT_EVALUATED') AS harness FROM
 (SELECT c_custkey AS seg, c_mktsegment AS state FROM customer WHERE c_nationkey < 15) g FULL JOIN (SELECT c_custkey AS seg, CASE WHEN c_acctbal > 0 THEN 'PASS' ELSE 'FAIL' END AS state FROM customer WHERE c_nationkey > 9) h ON g.seg = h.seg""")
def generation_harness_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    g = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("instance"), F.col("c_mktsegment").alias("g"))
    h = c.where("c_nationkey > 9").select(F.col("c_custkey").alias("instance"), F.when(F.col("c_acctbal") > 0, "PASS").otherwise("FAIL").alias("h"))
    return g.join(h, "instance", "full").select("instance", F.coalesce("g", F.lit("NOT_GENERATED")).alias("generation"), F.coalesce("h", F.lit("NOT_EVALUATED")).alias("harness"))


@query("SELECT l_shipdate IS NULL AS missing, l_linestatus AS stage, count(*) AS n, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def stage_timing_summary(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").isNull().alias("missing"), F.col("l_linestatus").alias("stage")).agg(F.count("*").alias("n"), F.sum(q).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.max(q).alias("most"))


@query("""SELECT o_custkey AS instance, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o FROM (SELECT o_custkey, o_orderstatus, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY 1""")
def case_process_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instance"), F.col("o_orderstatus").alias("s"), F.floor("o_totalprice").cast("double").alias("v"))
    out = rows.groupBy("instance").pivot("s", ["F", "O"]).agg(F.sum("v"))
    return out.select("instance", F.col("F").alias("f"), F.col("O").alias("o"))


@query(f"WITH {OUT}, p AS (SELECT requirement, kind, list_sort(list(DISTINCT path)) AS paths FROM outcome GROUP BY 1, 2) SELECT b.requirement, CAST(len(list_filter(a.paths, lambda x: NOT list_contains(b.paths, x))) AS INTEGER) AS added, CAST(len(list_filter(b.paths, lambda x: NOT list_contains(a.paths, x))) AS INTEGER) AS dropped FROM p b JOIN p a USING (requirement) WHERE b.kind = 'PRESERVATION' AND a.kind = 'TARGET'")
def progress_metrics(spark, sf_dir):
    """Set differences before and after, as counts."""
    sets = outcomes(spark, sf_dir).groupBy("requirement").agg(F.collect_set(F.when(F.col("kind") == "PRESERVATION", F.col("path"))).alias("b"), F.collect_set(F.when(F.col("kind") == "TARGET", F.col("path"))).alias("a"))
    return sets.where("size(a) > 0 and size(b) > 0").select("requirement", F.size(F.array_except("a", "b")).alias("added"), F.size(F.array_except("b", "a")).alias("dropped"))


@query(f"WITH {OUT} SELECT requirement, unit, losing FROM (SELECT requirement, unit, count(*) AS losing FROM outcome WHERE status <> 'PASS' GROUP BY requirement, unit) QUALIFY row_number() OVER (PARTITION BY requirement ORDER BY losing DESC, unit) = 1")
def worst_unit(spark, sf_dir):
    counts = outcomes(spark, sf_dir).where("status <> 'PASS'").groupBy("requirement", "unit").agg(F.count("*").alias("losing"))
    best = Window.partitionBy("requirement").orderBy(F.desc("losing"), "unit")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
