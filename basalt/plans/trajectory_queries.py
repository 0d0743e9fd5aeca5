"""Queries over trajectories: a customer is a run, its orders are patches and transitions."""

from __future__ import annotations

from ..operators import trajectory as tj
from .views import Registry, View, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

RUNS = View("runs", "customer", run="c_custkey")
PATCHES = View("patches", "orders", run="o_custkey", seq="o_orderkey", hash="concat('h', CAST(o_orderkey % 11 AS STRING))", has_diff="o_custkey % 8 <> 0 AND o_orderkey % 4 <> 0")
TRANSITIONS = View("transitions", "orders", run="o_custkey", seq="o_orderkey", transition="concat('t', CAST(o_orderkey AS STRING))", before_hash="CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('h', CAST((o_orderkey + 3) % 11 AS STRING)) END", after_hash="CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('h', CAST(o_orderkey % 11 AS STRING)) END", cumulative_hash="CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 'h1' END", confirmed="o_orderkey % 3 <> 0", target_delta="o_custkey % 3 - 1", regression_delta="o_orderkey % 5 - 1", mechanical_delta="CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE NULL END", mechanical_failures="CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END")
_REVISED = cte(RUNS, PATCHES, TRANSITIONS) + """, f AS (SELECT run, arg_min(hash, seq) AS first, count(DISTINCT hash) AS n FROM patches WHERE has_diff GROUP BY run),
t AS (SELECT x.* EXCLUDE (after_hash, before_hash), first, coalesce(nullif(after_hash, ''), cumulative_hash, '') AS aft, coalesce(before_hash, '') AS bef FROM transitions x JOIN f USING (run)),
c AS (SELECT run, min(seq) AS created FROM t WHERE aft = first AND bef <> first GROUP BY run),
r AS (SELECT t.*, confirmed AND (target_delta > 0 OR regression_delta < 0 OR coalesce(mechanical_delta, 0) > 0) AND mechanical_failures = 0 AS up FROM t LEFT JOIN c USING (run) WHERE created IS NULL OR seq <> created)"""


@query(_REVISED + " SELECT run, seq, transition, bef AS before_hash, aft AS after_hash, CASE WHEN confirmed THEN 'ELIGIBLE_FOR_POLICY_EVALUATION' ELSE 'REJECT_NO_CONFIRMED_COMPARABLE_EXECUTION' END AS decision, up AS promoted FROM r")
def trajectory_revisions(spark, sf_dir):
    return tj.revisions(PATCHES.frame(spark, sf_dir), TRANSITIONS.frame(spark, sf_dir))


@query(_REVISED + """, s AS (SELECT run, count(*) AS revisions, count(*) FILTER (up) AS promoted, arg_max(nullif(aft, ''), seq) FILTER (up) AS last, bool_or(bef = first AND aft <> first) AS modified FROM r GROUP BY run)
SELECT run, CASE WHEN first IS NULL THEN 'NO_NONEMPTY_CHECKPOINT' ELSE 'REPLAYED' END AS status, coalesce(first, '') AS first_patch, coalesce(last, first, '') AS selected_patch, coalesce(n, 0) AS patches, coalesce(revisions, 0) AS revisions, coalesce(promoted, 0) AS promoted, coalesce(modified, false) AS modified,
  first IS NOT NULL AND coalesce(last, first) = first AS used_first FROM runs LEFT JOIN f USING (run) LEFT JOIN s USING (run)""")
def trajectory_report(spark, sf_dir):
    return tj.report(*[v.frame(spark, sf_dir) for v in (RUNS, PATCHES, TRANSITIONS)])
