"""Queries over locked trials: an order is a trial, its lineitems are the locked checks and their runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trials
from .projections import table
from .views import Registry, View, cases, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_CHECK = {"trial": "l_orderkey", "check_id": "concat('c', CAST(l_linenumber AS STRING))"}
#: One row per (trial, check): the tables hold a line number twice now and then, so the least part stands for it.
LINES = View("raw", "lineitem", part="l_partkey", quantity="l_quantity", flag="l_returnflag", line="l_linenumber", **_CHECK)
_ONE = "one AS (SELECT trial, check_id, line, min(part) AS part, max(quantity) AS quantity, min(flag) AS flag FROM raw GROUP BY trial, check_id, line)"
_STATUS = lambda k: f"CASE WHEN {k} % 10 < 4 THEN 'PASS' WHEN {k} % 10 < 9 THEN 'FAIL' WHEN {k} % 20 = 9 THEN 'FLAKY' ELSE 'PASS' END"
_SIDES = {
    "locked": "SELECT trial, check_id, CASE line % 4 WHEN 0 THEN 'PRESERVATION' WHEN 1 THEN 'TARGET' WHEN 2 THEN 'COUNTEREXAMPLE' ELSE 'MECHANICAL' END AS role FROM one WHERE part % 97 <> 0",
    "before": f"SELECT trial, check_id, {_STATUS('part')} AS status, part % 41 <> 0 AS stable FROM one WHERE part % 89 <> 1",
    "after": f"SELECT trial, check_id, {_STATUS('(part + CAST(quantity AS INT))')} AS status, part % 43 <> 0 AS stable FROM one",
    "was": "SELECT trial, check_id, CASE WHEN part % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM one",
}
_ALL = cte(LINES) + f", {_ONE}, " + ", ".join(f"{k} AS ({v})" for k, v in _SIDES.items())


def _sides(spark, sf_dir):
    one = LINES.frame(spark, sf_dir).groupBy("trial", "check_id", "line").agg(F.min("part").alias("part"), F.max("quantity").alias("quantity"), F.min("flag").alias("flag"))
    out = []
    for sql in _SIDES.values():
        columns, _, where = sql.removeprefix("SELECT ").partition(" FROM one")
        rows = one.where(where.removeprefix(" WHERE ")) if where else one
        out.append(rows.selectExpr(*_split(columns)))
    return out


def _split(columns: str) -> list[str]:
    """Column expressions at top level of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


_IDS = ["target_pass_before", "target_pass_after", "target_fail_before", "target_fail_after", "regressions_before", "regressions_after", "mechanical_before", "mechanical_after", "unknown"]
_UNTELLING = "('TIMEOUT', 'FLAKY', 'INVALID_ENVIRONMENT', 'INVALID_SELECTOR', 'UNSUPPORTED')"
_TARGET = "role IN ('TARGET', 'COUNTEREXAMPLE')"
_KEEPS = "role = 'PRESERVATION' AND was = 'PASS'"
_COMPARED = _ALL + f""", j AS (
  SELECT coalesce(l.trial, b.trial, a.trial) AS trial, coalesce(l.check_id, b.check_id, a.check_id) AS check_id, l.role, b.status AS bs, a.status AS af, b.stable AS bok, a.stable AS aok, w.status AS was
  FROM locked l FULL JOIN before b ON l.trial = b.trial AND l.check_id = b.check_id FULL JOIN after a ON a.trial = coalesce(l.trial, b.trial) AND a.check_id = coalesce(l.check_id, b.check_id)
  LEFT JOIN was w ON w.trial = coalesce(l.trial, b.trial, a.trial) AND w.check_id = coalesce(l.check_id, b.check_id, a.check_id)),
t AS (SELECT *, coalesce(bs NOT IN {_UNTELLING} AND af NOT IN {_UNTELLING} AND bok AND aok, false) AS tells FROM j),
compared AS (SELECT trial, bool_and(role IS NOT NULL AND tells) AS comparable,
""" + ",\n".join(
    f"  list_sort(list(check_id) FILTER ({c})) AS {n}"
    for n, c in zip(_IDS, [f"{_TARGET} AND bs = 'PASS'", f"{_TARGET} AND af = 'PASS'", f"{_TARGET} AND bs = 'FAIL'", f"{_TARGET} AND af = 'FAIL'", f"{_KEEPS} AND bs = 'FAIL'", f"{_KEEPS} AND af = 'FAIL'", "role = 'MECHANICAL' AND bs = 'FAIL'", "role = 'MECHANICAL' AND af = 'FAIL'", "role IS NOT NULL AND NOT tells"], strict=True)
) + " FROM t GROUP BY trial)"
_N = lambda c: f"coalesce(len({c}), 0)"


def _compared(spark, sf_dir):
    return trials.compare_observations(*_sides(spark, sf_dir))


@query(_COMPARED + " SELECT trial, comparable, " + ", ".join(f"coalesce(array_to_string({c}, ','), '') AS {c}" for c in _IDS) + " FROM compared")
def locked_trial_comparison(spark, sf_dir):
    return _compared(spark, sf_dir).select("trial", "comparable", *[F.array_join(c, ",").alias(c) for c in _IDS])


@query(_COMPARED + f""", n AS (SELECT trial, comparable, {_N('unknown')} AS u, {_N('target_pass_after')} - {_N('target_pass_before')} AS t, {_N('regressions_before')} AS r0, {_N('regressions_after')} AS r1, {_N('mechanical_before')} AS m0, {_N('mechanical_after')} AS m1 FROM compared)
SELECT trial, CASE WHEN NOT comparable OR u > 0 THEN 'ROLLBACK' WHEN t > 0 AND r1 > 0 THEN 'KEEP_TRIAL_FOR_REGRESSION_REPAIR' WHEN (t > 0 OR (t = 0 AND r0 > r1) OR (m0 > m1 AND m1 = 0)) AND r1 = 0 AND m1 = 0 THEN 'PROMOTE' ELSE 'ROLLBACK' END AS decision,
  CASE WHEN NOT comparable OR u > 0 THEN 'LOCKED_CHECK_RESULTS_NOT_COMPARABLE' WHEN t > 0 AND r1 > 0 THEN 'TARGET_FIXED_WITH_CONFIRMED_PRESERVATION_REGRESSION'
    WHEN (t > 0 OR (t = 0 AND r0 > r1)) AND r1 = 0 AND m1 = 0 THEN 'CONFIRMED_EXECUTION_IMPROVEMENT' WHEN m0 > m1 AND m1 = 0 AND r1 = 0 THEN 'CONFIRMED_MECHANICAL_HEALTH_IMPROVEMENT' ELSE 'NO_CONFIRMED_IMPROVEMENT' END AS reason FROM n""")
def decide_transition(spark, sf_dir):
    return trials.decide(_compared(spark, sf_dir))


_DELTAS = {"target_pass_delta": ("target_pass_after", "target_pass_before"), "target_failure_delta": ("target_fail_after", "target_fail_before"), "regression_delta": ("regressions_after", "regressions_before"), "counterexample_delta": ("target_fail_after", "target_fail_before"), "mechanical_health_delta": ("mechanical_before", "mechanical_after")}


@query(_COMPARED + " SELECT trial, " + ", ".join(f"CAST(CASE WHEN comparable AND unknown IS NULL THEN {_N(a)} - {_N(b)} ELSE 0 END AS BIGINT) AS {n}" for n, (a, b) in _DELTAS.items()) + ", CAST(CASE WHEN comparable AND unknown IS NULL THEN len(list_filter(coalesce(target_pass_after, []), lambda x: NOT list_contains(coalesce(target_pass_before, []), x))) ELSE 0 END AS BIGINT) AS requirement_delta FROM compared")
def trial_progress(spark, sf_dir):
    return trials.trial_progress(_compared(spark, sf_dir))


@query(_COMPARED + f" SELECT trial, CAST({_N('target_pass_after')} AS BIGINT) AS target_passes, CAST({_N('target_fail_after')} AS BIGINT) AS target_failures, CAST({_N('regressions_after')} AS BIGINT) AS regressions, CAST({_N('mechanical_after')} AS BIGINT) AS mechanical_failures FROM compared")
def trial_evidence_vector(spark, sf_dir):
    return trials.evidence_vector(_compared(spark, sf_dir))


FAILURES = View("failures", "orders", owner="o_custkey", failure="concat('f', CAST(o_orderkey AS STRING))", kind=cases("o_orderkey", "CONFIRMED_TARGET_FAILURE", "CONFIRMED_DICC_COUNTEREXAMPLE", "SUSPECTED", "CONFIRMED_PRESERVATION_REGRESSION", "CONFIRMED_MECHANICAL_FAILURE"), authority=cases("o_custkey", "A", "D", "B", "C", "E"), stable_runs="o_orderkey % 4", executable="o_orderkey % 6 <> 0", comparable="o_orderkey % 7 <> 0")


@query(cte(FAILURES) + """ SELECT owner, arg_max(failure, (rank, failure)) AS failure FROM (SELECT *, CASE kind WHEN 'CONFIRMED_MECHANICAL_FAILURE' THEN 4 WHEN 'CONFIRMED_PRESERVATION_REGRESSION' THEN 3 WHEN 'CONFIRMED_TARGET_FAILURE' THEN 2 WHEN 'CONFIRMED_DICC_COUNTEREXAMPLE' THEN 1 ELSE 0 END AS rank FROM failures)
WHERE rank > 0 AND authority IN ('A', 'B', 'C') AND stable_runs >= 2 AND executable AND comparable GROUP BY owner""")
def selected_confirmed_failure(spark, sf_dir):
    return trials.select_confirmed_failure(FAILURES.frame(spark, sf_dir), "owner")


_PAIR = {"owner": "o_custkey", "check_id": "concat('k', CAST(o_orderkey % 5 AS STRING))", "class": cases("o_orderkey", "TARGET_FIXED", "TARGET_STILL_FAILING", "TARGET_REGRESSED", "PASS_PRESERVED", "PRESERVATION_REGRESSION", "TARGET_FIXED", "TARGET_STILL_FAILING"), "baseline": cases("o_orderkey", "FAIL", "PASS", "FAIL", "TIMEOUT"), "baseline_stable": "o_orderkey % 11 <> 0", "baseline_signature": "substring(o_orderpriority, 1, 1)", "patched": cases("o_orderkey", "PASS", "FAIL", "FAIL"), "patched_stable": "o_orderkey % 13 <> 0", "patched_signature": "substring(o_orderpriority, 1, 1)"}
PAIRS = View("pairs", "orders", is_old="o_orderkey % 2 = 0", **_PAIR)
_LIST = lambda where, c="check_id": f"coalesce(list(DISTINCT {c}) FILTER ({where}), [])"
_OPEN = "class IN ('TARGET_STILL_FAILING', 'TARGET_REGRESSED')"
_WORSE = "class IN ('TARGET_REGRESSED', 'PRESERVATION_REGRESSION')"


@query(cte(PAIRS) + f""", k AS (SELECT * FROM pairs WHERE baseline <> 'TIMEOUT' AND baseline_stable AND patched_stable),
o AS (SELECT owner, {_LIST("class = 'TARGET_FIXED'")} AS fixed, {_LIST(_OPEN)} AS open, {_LIST("class = 'TARGET_STILL_FAILING'", 'patched_signature')} AS signs, count(*) FILTER ({_WORSE}) AS worse FROM k WHERE is_old GROUP BY owner),
n AS (SELECT owner, {_LIST("class = 'TARGET_FIXED'")} AS fixed, {_LIST(_OPEN)} AS open, {_LIST("class = 'TARGET_STILL_FAILING'", 'patched_signature')} AS signs, count(*) FILTER ({_WORSE}) AS worse, {_LIST("baseline = 'FAIL'")} AS failed, {_LIST("baseline = 'FAIL'", 'baseline_signature')} AS first_signs FROM k WHERE NOT is_old GROUP BY owner)
SELECT owner, CAST(len(n.fixed) - coalesce(len(o.fixed), 0) AS BIGINT) AS target_pass_delta, CAST(len(n.open) - len(CASE WHEN o.owner IS NULL THEN failed ELSE o.open END) AS BIGINT) AS target_failure_delta, CAST(n.worse - coalesce(o.worse, 0) AS BIGINT) AS regression_delta,
  CAST(len(n.signs) - len(CASE WHEN o.owner IS NULL THEN first_signs ELSE o.signs END) AS BIGINT) AS counterexample_delta, CAST(len(list_filter(n.fixed, lambda x: NOT list_contains(coalesce(o.fixed, []), x))) AS BIGINT) AS requirement_delta FROM n LEFT JOIN o USING (owner)""")
def progress_from_comparisons(spark, sf_dir):
    p = PAIRS.frame(spark, sf_dir)
    return trials.progress_from_comparisons(p.where("is_old"), p.where("not is_old"), "owner")


CANDIDATES = View("candidates", "orders", recovery="o_orderkey", check_id="concat('t', CAST(o_custkey AS STRING))", explicit=cases("o_orderkey", "", "a", "D", "", "b", ""), fallback=cases("o_custkey", "PUBLIC", "", "c"), strategy=cases("o_orderkey", "llm_reproduction", "x", "Related_Public_Test", "issue_executable_witness", "baseline_differential_relation", "other", "public_repository_test"), expected_baseline=cases("o_custkey", "FAIL", "PASS"), n_symbols="o_orderkey % 3")
TARGETS = View("targets", "orders", recovery="o_orderkey", check_id="concat('t', CAST(o_custkey AS STRING))", n_requirements="o_orderkey % 4")
EXECUTIONS = View("executions", "orders", recovery="o_orderkey", check_id="concat('t', CAST(o_custkey AS STRING))", status="CASE o_orderstatus WHEN 'F' THEN 'FAIL' ELSE 'PASS' END", stable="o_orderkey % 5 <> 0")
_CATALOG = """, last AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY check_id ORDER BY recovery DESC) = 1),
lettered AS (SELECT *, upper(CASE WHEN explicit <> '' THEN explicit ELSE fallback END) AS given, lower(strategy) AS how FROM last),
catalog AS (SELECT check_id, strategy, recovery, n_symbols, CASE WHEN given IN ('A', 'B', 'C') THEN given WHEN how = 'llm_reproduction' THEN 'E' WHEN how IN ('related_public_test', 'public_repository_test') AND expected_baseline = 'FAIL' THEN 'A'
  WHEN how = 'issue_executable_witness' THEN 'B' WHEN how = 'baseline_differential_relation' THEN 'C' ELSE 'UNTRUSTED' END AS authority FROM lettered)"""


@query(cte(CANDIDATES, TARGETS, EXECUTIONS) + _CATALOG + """ SELECT check_id, authority, strategy, stable, status AS baseline_status, authority IN ('A', 'B', 'C') AS trusted,
  authority IN ('A', 'B', 'C') AND stable AND status = 'FAIL' AND n_requirements > 0 AND n_symbols > 0 AS certified FROM catalog JOIN executions USING (recovery, check_id) JOIN targets USING (recovery, check_id)""")
def target_catalog(spark, sf_dir):
    return trials.target_catalog(*[v.frame(spark, sf_dir) for v in (CANDIDATES, TARGETS, EXECUTIONS)])


TRANSITIONS = View("transitions", "customer", transition="c_custkey", mechanical_checks="CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 0 END", mechanical_pass="c_custkey % 9 <> 0")
COMPARED = View("compares", "orders", transition="o_custkey + 1", check_id="concat('t', CAST(o_custkey AS STRING))")


@query(cte(CANDIDATES, TRANSITIONS, COMPARED) + _CATALOG + """, l AS (SELECT transition, min(authority) FILTER (authority IN ('A', 'B', 'C')) AS letter, bool_or(authority = 'E') AS e FROM compares JOIN catalog USING (check_id) GROUP BY transition)
SELECT transition, CASE WHEN mechanical_checks > 0 THEN 'MECHANICAL' WHEN letter IS NOT NULL THEN letter WHEN e THEN 'E' ELSE 'UNTRUSTED' END AS authority FROM transitions LEFT JOIN l USING (transition)""")
def transition_authority(spark, sf_dir):
    catalog = trials.target_catalog(*[v.frame(spark, sf_dir) for v in (CANDIDATES, TARGETS, EXECUTIONS)])
    return trials.transition_authority(TRANSITIONS.frame(spark, sf_dir), COMPARED.frame(spark, sf_dir), catalog)


LOCKS = View("locks", "customer", transition="c_custkey", kind="c_custkey % 6", name="c_mktsegment", authority=cases("c_nationkey", "A", "E", "C", "UNTRUSTED"), mechanical_checks="CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 0 END", n_compared="c_custkey % 3", mechanical_pass="c_custkey % 9 <> 0", stable="c_custkey % 4 <> 0")


@query(cte(LOCKS) + """, c AS (SELECT *, CASE kind WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN '' WHEN 4 THEN 'a' ELSE 'a' END AS before, CASE kind WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN '' WHEN 4 THEN 'z' ELSE 'b' END AS after FROM locks),
d AS (SELECT *, before <> '' AND before = after AS comparable FROM c)
SELECT transition, before, after, comparable, (authority IN ('A', 'C') OR (mechanical_checks > 0 AND stable)) AND comparable AND (n_compared > 0 OR (mechanical_checks > 0 AND stable)) AND mechanical_pass AS confirmed FROM d""")
def locked_comparison(spark, sf_dir):
    """Which list of ids counts: the locked set's (a), else the trial's (b), else the executed ones (c, z)."""
    k = F.col("kind")
    none, some = F.array().cast("array<string>"), lambda v: F.array(F.lit(v))
    pick = lambda *rules: F.struct(*[F.coalesce(*[F.when(k.isin(ks), some(v)) for ks, v in rule], none).alias(side) for side, rule in zip(("before", "after"), rules, strict=True)])
    locked = pick([([0, 4, 5], "a")], [([0], "a")])
    trial = pick([([1], "b")], [([1, 5], "b")])
    ran = pick([([2], "c")], [([2], "c"), ([4], "z")])
    out = trials.locked_comparison(locked, trial, ran)
    runs = F.array(F.struct(F.lit("PASS").alias("status"), F.col("stable").alias("stable")))
    confirmed = trials.confirmed_transition(F.col("authority"), out["comparable"], F.col("mechanical_checks"), runs, runs, F.col("n_compared"), F.col("mechanical_pass"))
    return LOCKS.frame(spark, sf_dir).select("transition", F.array_join(out["before"], ",").alias("before"), F.array_join(out["after"], ",").alias("after"), out["comparable"].alias("comparable"), confirmed.alias("confirmed"))


@query("""WITH t AS (SELECT o_custkey AS trajectory, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, o_totalprice) FILTER (o_orderstatus = 'F') AS best FROM orders GROUP BY 1) SELECT trajectory, coalesce(best, first) AS patch FROM t""")
def final_patch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    best = F.max_by("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    rows = o.groupBy(F.col("o_custkey").alias("trajectory")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_patch"), best.alias("best_evidence_patch"))
    return trials.finalize_best_patch(rows)


WITNESSES = View("witnesses", "customer", candidate="concat('w', CAST(c_custkey AS STRING))", relation="CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 'baseline_failure_must_become_pass' END", executable="c_custkey % 7 <> 0", authority=cases("c_custkey", "A", "B", "E", "C"), stability_runs="c_custkey % 5")
WITNESS_RUNS = View("witness_runs", "orders", candidate="concat('w', CAST(o_custkey AS STRING))", check_id="concat('w', CAST(o_custkey AS STRING))", status="CASE o_orderstatus WHEN 'P' THEN 'PASS' ELSE 'FAIL' END", stable="o_orderkey % 30 <> 0", return_code="CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE 1 END", output="CASE WHEN o_orderkey % 25 = 0 THEN 'E: Connection refused' ELSE 'assert 1 == 2' END")
WITNESS_UNITS = View("witness_units", "orders", unit="o_orderkey", check_id="concat('w', CAST(o_custkey AS STRING))", symbol="concat('s', CAST(o_orderkey % 9 AS STRING))")
WITNESS_EDGES = View("witness_edges", "customer", type="CASE WHEN c_nationkey = 1 THEN 'CALLS' ELSE 'CHECK_EXECUTED_SYMBOL' END", source="concat('w', CAST(c_custkey AS STRING))", target="concat('s', CAST(c_custkey % 9 AS STRING))")


@query(cte(WITNESSES, WITNESS_RUNS, WITNESS_UNITS, WITNESS_EDGES) + """,
r AS (SELECT candidate, bool_and(stable) AS stable, bool_and(status = 'FAIL' AND stable AND return_code <> 0 AND NOT contains(lower(output), 'connection refused')) AS fails FROM witness_runs GROUP BY candidate),
hit AS (SELECT DISTINCT u.check_id AS candidate FROM witness_units u JOIN witness_edges e ON e.source = u.check_id AND e.target = u.symbol WHERE type = 'CHECK_EXECUTED_SYMBOL'),
g AS (SELECT w.candidate, array_to_string(list_filter([CASE WHEN NOT executable OR authority = 'E' THEN 'trusted_oracle' END, CASE WHEN stability_runs < 2 OR NOT coalesce(stable, false) THEN 'stable_execution' END,
  CASE WHEN NOT executable OR relation = 'other' OR NOT coalesce(fails, false) THEN 'exposes_issue' END, CASE WHEN hit.candidate IS NULL THEN 'reaches_related_code' END], lambda x: x IS NOT NULL), ',') AS missing
  FROM witnesses w LEFT JOIN r USING (candidate) LEFT JOIN hit USING (candidate))
SELECT candidate, missing = '' AS certified, CASE WHEN missing = '' THEN 'CERTIFIED' ELSE 'MISSING:' || missing END AS reason FROM g""")
def certified_targets(spark, sf_dir):
    return trials.certify(*[v.frame(spark, sf_dir) for v in (WITNESSES, WITNESS_RUNS, WITNESS_UNITS, WITNESS_EDGES)])
