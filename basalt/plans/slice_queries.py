"""Queries over diffs, frames, budgets and scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slices as sl
from .projections import G, g_edges, table
from .views import Registry, View, cases, cte

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_K = "CAST(o_orderkey AS STRING)"
DIFFS = View("diffs", "orders", diff="o_orderkey", file=cases("o_custkey", "a.py", "b/c.py"), text=f"concat('--- a', chr(10), '+++ b', chr(10), '@@ -', {_K}, ',3 +', CAST(o_custkey AS STRING), ' @@ def f', chr(10), ' same', chr(10), '-old ', o_orderpriority, chr(10), '+new', chr(10), '+more', CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(10), '@@ -900 +901,2 @@', chr(10), '--- x', chr(10), '+last') ELSE '' END)")


@query(cte(DIFFS) + """, h AS (SELECT diff, file, 1 AS place, diff AS old_start, 3 AS old_count, CAST(split_part(split_part(text, ' +', 2), ' @@', 1) AS BIGINT) AS new_start, 1 AS new_count, 'new,more' AS added, 'old ' || split_part(split_part(text, '-old ', 2), chr(10), 1) AS deleted FROM diffs
UNION ALL SELECT diff, file, 2, 900, 1, 901, 2, 'last', '' FROM diffs WHERE diff % 3 = 0)
SELECT diff, file, CAST(place AS INTEGER) AS place, old_start, CAST(old_count AS BIGINT) AS old_count, new_start, CAST(new_count AS BIGINT) AS new_count, added, deleted,
  'diff-hunk-' || substr(sha256('["' || file || '",' || old_start || ',' || new_start || ',' || CASE place WHEN 1 THEN '["new","more"],["' || deleted || '"]' ELSE '["last"],[]' END || ']'), 1, 24) AS hunk FROM h""")
def parse_hunks(spark, sf_dir):
    return sl.parse_hunks(DIFFS.frame(spark, sf_dir)).withColumn("added", F.array_join("added", ",")).withColumn("deleted", F.array_join("deleted", ","))


RUNS = View("runs", "orders", run="o_orderkey", output="CASE o_orderkey % 5 WHEN 0 THEN concat('  File \"/work/pkg/a.py\", line ', CAST(o_custkey AS STRING), ', in run', chr(10), '  File \"/work/tests/t.py\", line 3, in test_x', chr(10), '  File \"/usr/lib/x.py\", line 9, in z') WHEN 1 THEN concat('  File \"tests/t.py\", line 7, in test_y ', chr(10), 'E') WHEN 2 THEN concat('x', chr(10), 'pkg/b.py:', CAST(o_custkey AS STRING), ': boom') WHEN 3 THEN 'File \"/usr/a.py\", line 1, in q' ELSE 'nothing' END")


@query(cte(RUNS) + """ SELECT run, CASE run % 5 WHEN 0 THEN 'pkg/a.py' WHEN 1 THEN 'tests/t.py' ELSE 'pkg/b.py' END AS file, CASE run % 5 WHEN 0 THEN CAST(regexp_extract(output, 'line ([0-9]+), in run', 1) AS BIGINT) WHEN 1 THEN 7 ELSE CAST(regexp_extract(output, 'b.py:([0-9]+)', 1) AS BIGINT) END AS line,
  CASE run % 5 WHEN 0 THEN 'run' WHEN 1 THEN 'test_y' ELSE '<failure>' END AS symbol FROM runs WHERE run % 5 < 3""")
def first_project_frame(spark, sf_dir):
    return sl.first_project_frame(RUNS.frame(spark, sf_dir), "/work")


FILES = View("files", "lineitem", slice="l_suppkey", place="l_orderkey", file="l_partkey", nodes="CAST(l_quantity AS INT)", edges="l_linenumber * 10", functions="l_linenumber")


@query()
def admitted_files(spark, sf_dir):
    """Which files of each slice fit. What is taken depends on all before, so there is no SQL: a test holds it against a
    loop."""
    from pyspark.sql import Window

    first = FILES.frame(spark, sf_dir).groupBy("slice", "file").agg(F.min(F.struct("place", "nodes", "edges", "functions")).alias("x")).select("slice", "file", "x.*")
    ordered = first.withColumn("place", F.row_number().over(Window.partitionBy("slice").orderBy("place", "file")))
    return sl.admit_files(ordered, {"files": 5, "nodes": 120, "edges": 200, "functions": 20})


ISSUES = View("issues", "supplier", issue="s_suppkey", words=cases("s_suppkey", "economy widget standard", "promo bolt", "cold economy", "nothing here"))
REFERENCES = View("refs", "part", path="concat('tests/test_', lower(p_brand), '_', lower(replace(p_type, ' ', '_')), '.py')", words="concat(lower(p_type), ' ', lower(p_name))")


@query(cte(ISSUES, REFERENCES) + """, t AS (SELECT DISTINCT issue, unnest(string_split(words, ' ')) AS token FROM issues), n AS (SELECT DISTINCT path, unnest(string_split(words, ' ')) AS token FROM refs),
s AS (SELECT issue, path, sum(CASE WHEN length(token) >= 8 THEN length(token) ELSE 0 END) AS long, count(*) AS n FROM t JOIN n USING (token) GROUP BY ALL),
f AS (SELECT s.*, coalesce((SELECT sum(length(token)) FROM t WHERE t.issue = s.issue AND length(token) >= 5 AND contains(regexp_replace(lower(path), '[^a-z0-9]', '', 'g'), token)), 0) AS fits FROM s)
SELECT issue, path, CAST(place AS INTEGER) AS place FROM (SELECT issue, path, row_number() OVER (PARTITION BY issue ORDER BY fits DESC, long DESC, n DESC, path) AS place FROM f) WHERE place <= 20""")
def related_tests(spark, sf_dir):
    words = lambda v, key: v.frame(spark, sf_dir).select(key, F.explode(F.split("words", " ")).alias("token"))
    none = spark.createDataFrame([], "issue long, path string")
    return sl.related_tests(words(ISSUES, "issue"), words(REFERENCES, "path").withColumnRenamed("token", "name"), none)


STATE_TARGETS = View("state_targets", "lineitem", state="l_orderkey", check_id="l_linenumber")
STATE_PAIRS = View("state_pairs", "lineitem", state="l_orderkey", seq="l_partkey", check_id="l_linenumber", **{"class": cases("l_partkey", "TARGET_FIXED", "TARGET_STILL_FAILING", "TARGET_FIXED", "FLAKY_RESULT")}, has="l_suppkey % 4 <> 0")


@query(cte(STATE_TARGETS, STATE_PAIRS) + ", l AS (SELECT state, check_id, arg_max(class, seq) AS class FROM state_pairs WHERE has GROUP BY ALL) SELECT state, count(*) FILTER (coalesce(class, '') <> 'TARGET_FIXED') AS deficit FROM (SELECT DISTINCT state, check_id FROM state_targets) LEFT JOIN l USING (state, check_id) GROUP BY state")
def state_target_deficit(spark, sf_dir):
    return sl.state_deficit(STATE_TARGETS.frame(spark, sf_dir), STATE_PAIRS.frame(spark, sf_dir).where("has"))


TREE_FILES = View("tree_files", "orders", tree="o_custkey", path=f"concat('f', {_K}, '.py')", content="o_orderpriority")


@query(cte(TREE_FILES) + " SELECT tree, sha256(string_agg(path || chr(10) || sha256(content) || chr(10), '' ORDER BY path)) AS digest FROM tree_files GROUP BY tree")
def tree_hash(spark, sf_dir):
    return sl.tree_digest(TREE_FILES.frame(spark, sf_dir).select("tree", "path", F.sha2("content", 256).alias("content_hash")))


@query(f"""WITH RECURSIVE {G}, t(node, hops) AS (SELECT 'p:3', 0 UNION SELECT g.src, t.hops + 1 FROM g JOIN t ON g.dst = t.node), d AS (SELECT node, min(hops) AS hops FROM t GROUP BY node),
s AS (SELECT g.src AS node, min((kind || ':' || src || '>' || dst, dst)) AS x FROM g JOIN d a ON g.src = a.node JOIN d b ON g.dst = b.node WHERE a.hops = b.hops + 1 GROUP BY g.src)
SELECT node, CAST(hops AS INTEGER) AS hops, x[2] AS parent, x[1] AS edge_id FROM d LEFT JOIN s USING (node)""")
def reverse_path_tree(spark, sf_dir):
    e = g_edges(spark, sf_dir)
    e = e.select(F.concat_ws(">", F.concat_ws(":", "kind", "src"), "dst").alias("edge_id"), "src", "dst")
    return sl.path_tree(e, spark.createDataFrame([("p:3",)], "node string"), forward=False)


LEAVES = View("leaves", "part", id="p_partkey", authority=cases("p_partkey", "A", "PROVISIONAL", "C"), authority_class=cases("p_size", "HARD", "DERIVED", "HARD", "PRESERVATION", "HARD"), kind=cases("p_partkey", "exception", "equality", "temporal", "metamorphic", "trace_predicate", "equality", "temporal"), keeps="p_partkey % 19 = 0", thrown=cases("p_size", "ValueError", "", "KeyError"), has_literal="p_size % 2 = 0", same_input="p_size % 3 = 0", formula=cases("p_size", "a before b after c", "it must precede", "sort is idempotent", "no order"))


@query(cte(LEAVES) + """, t AS (SELECT *, authority <> 'PROVISIONAL' AS ok, formula IN ('a before b after c', 'it must precede') AS ordered FROM leaves),
k AS (SELECT *, CASE WHEN authority_class = 'PRESERVATION' OR keeps THEN 'BASELINE_DIFFERENTIAL' WHEN kind = 'exception' AND thrown <> '' THEN 'EXPLICIT_EXCEPTION' WHEN kind = 'equality' AND (has_literal OR same_input) THEN 'EXPLICIT_RELATION' WHEN kind = 'temporal' AND ok AND ordered THEN 'RELATION_ORACLE' WHEN kind = 'metamorphic' AND ok THEN 'METAMORPHIC' ELSE 'EXPLORATION_ONLY' END AS found FROM t)
SELECT id, found AS kind, CASE found WHEN 'BASELINE_DIFFERENTIAL' THEN 'preservation' WHEN 'EXPLICIT_RELATION' THEN CASE WHEN has_literal THEN 'equality' ELSE 'input_identity' END WHEN 'METAMORPHIC' THEN 'idempotence' ELSE kind END AS relation,
  CASE WHEN found IN ('BASELINE_DIFFERENTIAL', 'RELATION_ORACLE') OR (found IN ('EXPLICIT_EXCEPTION', 'EXPLICIT_RELATION') AND ok) OR (found = 'METAMORPHIC' AND formula = 'sort is idempotent') THEN 'ACTIVE' ELSE 'DOWNGRADED' END AS lifecycle FROM k""")
def resolve_oracle(spark, sf_dir):
    out = sl.resolve_oracle(*[F.col(c) for c in ("authority", "authority_class", "kind", "keeps", "thrown", "has_literal", "same_input", "formula")])
    return LEAVES.frame(spark, sf_dir).select("id", out.alias("v")).select("id", "v.*")


EDITS = View("edits", "orders", id="o_orderkey", file=cases("o_orderkey", "pkg/a.py", "pkg/b.py", ""), cut=cases("o_custkey", "r1", "r2"), cut_symbol=cases("o_custkey", "pkg.A.f", "pkg.B", "pkg.A"), execution="CASE WHEN o_orderkey % 4 = 0 THEN 'x1' ELSE '' END", mechanical="o_orderkey % 9 = 0", changed=cases("o_orderkey", "pkg/a.py", "pkg/a.py", "pkg/utils/c.py", "pkg/b.py", "pkg/a.py"), relation=cases("o_orderkey", "r1", "r3"), scope=cases("o_orderkey", "pkg.A", "other", "A.f", "pkg.B.g"), kind=cases("o_custkey", "call_modified", "signature_modified", "call_added"))


@query(cte(EDITS) + """, s AS (SELECT *, scope = cut_symbol OR starts_with(scope, cut_symbol || '.') OR starts_with(cut_symbol, scope || '.') OR ends_with(scope, '.' || cut_symbol) OR ends_with(cut_symbol, '.' || scope) AS same FROM edits),
t AS (SELECT *, relation = cut OR same OR (mechanical AND file <> '' AND changed = file) AS touched, CASE WHEN file <> '' AND changed <> file THEN changed ELSE '' END AS lost_file, CASE WHEN NOT same THEN scope ELSE '' END AS lost_symbol FROM s)
SELECT id, touched AND lost_file = '' AND lost_symbol = '' AND NOT (changed = 'pkg/utils/c.py' AND changed <> file) AND NOT (kind = 'signature_modified' AND execution = '') AS allowed, touched, lost_file AS unexplained_files, lost_symbol AS unexplained_symbols FROM t""")
def accept_edit_scope(spark, sf_dir):
    some = lambda c: F.filter(F.array(c), lambda x: x != "")
    none = F.array().cast("array<string>")
    relations = F.array(F.struct(F.col("relation").alias("id"), "scope", "kind"))
    out = sl.accept_edit_scope(some("file"), F.array("cut"), none, F.array("cut_symbol"), none, some("execution"), F.col("mechanical"), F.array("changed"), relations)
    rows = EDITS.frame(spark, sf_dir).select("id", out.alias("v")).select("id", "v.*")
    return rows.withColumn("unexplained_files", F.array_join("unexplained_files", ",")).withColumn("unexplained_symbols", F.array_join("unexplained_symbols", ","))


@query("""SELECT l_orderkey AS graph, count(*) AS n, concat_ws('-', """ + ", ".join(f"CAST(sum(CAST('0x' || substr(sha256(l_partkey || ':' || l_suppkey || ':' || l_linenumber), {k}, 12) AS BIGINT)) AS VARCHAR)" for k in (1, 13, 25)) + """) AS digest FROM lineitem GROUP BY l_orderkey""")
def graph_hash(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), F.concat_ws(":", "l_partkey", "l_suppkey", "l_linenumber").alias("key"))
    return sl.graph_digest(items, "key", "graph")


@query("""SELECT doc_id AS path, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE contains(lower(content), 'license') AND NOT starts_with(content, 'License') ORDER BY path, line LIMIT 100""")
def find_callers(spark, sf_dir):
    """Lines that name a symbol without defining it; the first hundred by path and line are the report."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "content"))
    hit = lines.where(F.lower("content").contains("license") & ~F.startswith("content", F.lit("License")))
    return hit.select("path", (F.col("at") + 1).cast("long").alias("line")).orderBy("path", "line").limit(100)
