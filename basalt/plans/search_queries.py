"""Queries over many searches at once: slices of executions, ranked cuts, entrypoints, reach of all nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entrypoints as ep
from ..operators import requirements as rq
from ..operators import search as se
from ..operators.store import Rounds
from .projections import G, g_edges, g_nodes
from .views import Registry, View

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: The edges as a program's: kinds by the kind of edge and the number of its end.
_KINDS = {
    "kind": "CASE kind WHEN 'containment' THEN CASE WHEN dst LIKE 'n%' THEN 'exports' ELSE 'calls' END WHEN 'triggers' THEN CASE WHEN dst LIKE '%1' THEN 'dispatch' WHEN dst LIKE '%2' THEN 'exception_flow' ELSE 'parameter_flow' END ELSE kind END",
    "condition": "CASE WHEN kind = 'containment' AND dst LIKE 'c%3' THEN 'big' WHEN kind = 'triggers' AND dst LIKE '%4' THEN 'not (big)' WHEN kind = 'triggers' AND dst LIKE '%6' THEN 'late' WHEN kind = 'data_flow' AND dst LIKE '%5' THEN 'iterable(x)' ELSE 'True' END",
    "edge_id": "concat(kind, ':', src, '>', dst)",
}
_PROGRAM = f"{G}, e AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _KINDS.items())}, src, dst, confidence FROM g)"
_NUMBER = "CAST(substring(node, 3) AS BIGINT)"
_NODE = {
    "kind": "CASE substring(node, 1, 1) WHEN 'o' THEN 'call' WHEN 'p' THEN 'return' WHEN 'c' THEN 'branch' WHEN 's' THEN 'parameter' ELSE 'module' END",
    "file": f"concat(CASE WHEN {_NUMBER} % 10 = 9 THEN 'tests/' ELSE 'src/' END, substring(node, 1, 1), CAST({_NUMBER} % 50 AS STRING), '.py')",
    "line": f"1 + {_NUMBER} % 97",
    "end_line": f"1 + {_NUMBER} % 97 + {_NUMBER} % 4",
    "symbol": f"concat('Mod.', CASE WHEN {_NUMBER} % 2 = 0 THEN 'Run' ELSE 'Step' END, CAST({_NUMBER} % 7 AS STRING))",
}
_NODES = f"nodes AS (SELECT node, {', '.join(f'{v} AS {k}' for k, v in _NODE.items())} FROM (SELECT src AS node FROM g UNION SELECT dst FROM g))"
#: A failing execution per part and its frames: one in a part's file, the next in an order's.
FRAMES = View("frames", "part", search="p_partkey", own="concat('src/p', CAST(p_partkey % 50 AS STRING), '.py')", other="concat('src/o', CAST(p_size % 50 AS STRING), '.py')", line="1 + p_partkey % 97", word="concat('run', CAST(p_partkey % 7 AS STRING))", touched="concat('src/o', CAST(p_partkey % 50 AS STRING), '.py')")
_FRAMES = FRAMES.sql + ", f AS (SELECT search, 0 AS place, own AS file, line FROM frames UNION ALL SELECT search, 1, other, line FROM frames), st AS (SELECT search, node, min(place) AS d FROM f JOIN nodes n ON n.file = f.file AND f.line BETWEEN n.line AND n.end_line GROUP BY ALL)"


def program(spark, sf_dir):
    """(edges, nodes) of the program."""
    g = g_edges(spark, sf_dir)
    edges = g.selectExpr(*[f"{v} AS {k}" for k, v in _KINDS.items()], "src", "dst", "confidence")
    return edges, g_nodes(spark, sf_dir).selectExpr("node", *[f"{v} AS {k}" for k, v in _NODE.items()])


def _frames(spark, sf_dir):
    v = FRAMES.frame(spark, sf_dir)
    return v.select("search", F.lit(0).alias("place"), F.col("own").alias("file"), "line").union(v.select("search", F.lit(1), "other", "line"))


_CAUSES = "', '".join(se.CAUSAL)
_LIVE = f"l AS (SELECT * FROM e WHERE kind IN ('{_CAUSES}'))"


def _sliced(most: int, starts: str = "SELECT search, node, d FROM st") -> str:
    return f"""b(search, node, d) AS ({starts} UNION SELECT b.search, l.src, b.d + 1 FROM b JOIN l ON l.dst = b.node),
m AS (SELECT search, node, CAST(min(d) AS BIGINT) AS distance FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY distance, node) AS rn FROM m), s AS (SELECT search, node, distance FROM r WHERE rn <= {most})"""


_MOST = 60


@query(f"WITH {G}, {_NODES}, {_FRAMES} SELECT search, place, node FROM f JOIN nodes n ON n.file = f.file AND f.line BETWEEN n.line AND n.end_line")
def trace_nodes(spark, sf_dir):
    """Nodes at the frames of all executions."""
    return se.frame_nodes(_frames(spark, sf_dir), program(spark, sf_dir)[1])


@query(f"WITH RECURSIVE {_PROGRAM}, {_NODES}, {_FRAMES}, {_LIVE}, {_sliced(_MOST)} SELECT search, node, distance, search IN (SELECT search FROM r WHERE rn > {_MOST}) AS cut FROM s")
def causal_slices(spark, sf_dir):
    """Each execution's first sixty nodes backwards, all in one run, and whether its budget ended."""
    edges, nodes = program(spark, sf_dir)
    nodes = Rounds(spark, "program").put(nodes)
    member, starts = se.alike(_frames(spark, sf_dir), nodes, _MOST)
    slices, _, cut = se.causal_slices(edges, nodes.withColumn("predicate", F.lit(False)), starts, _MOST)
    return se.of_members(slices.join(cut.withColumn("cut", F.lit(True)), "search", "left").na.fill(False, ["cut"]), member)


@query(f"""WITH RECURSIVE {_PROGRAM}, {_NODES}, {_FRAMES}, {_LIVE}, {_sliced(_MOST)}, k AS (SELECT search, distance, nodes.* FROM s JOIN nodes USING (node))
SELECT search, 'branch' AS role, node AS id, CAST(NULL AS INTEGER) AS place FROM k WHERE kind = 'branch' OR line = 7
UNION SELECT search, CASE kind WHEN 'dispatch' THEN 'dispatch' ELSE 'exception' END, edge_id, NULL FROM s JOIN l ON l.dst = s.node WHERE kind IN ('dispatch', 'exception_flow')
UNION ALL SELECT search, 'candidate', node, CAST(row_number() OVER (PARTITION BY search ORDER BY distance, line, node) AS INTEGER) AS n FROM k WHERE kind NOT IN ('module', 'parameter') AND file NOT LIKE 'tests/%' QUALIFY n <= {se.CANDIDATES}""")
def causal_slice_roles(spark, sf_dir):
    edges, nodes = program(spark, sf_dir)
    nodes = Rounds(spark, "program").put(nodes)
    member, starts = se.alike(_frames(spark, sf_dir), nodes, _MOST)
    roles = se.causal_slices(edges, nodes.withColumn("predicate", F.col("line") == 7), starts, _MOST)[1]
    return se.of_members(roles, member)


_OBSERVES = "', '".join(se.OBSERVING)


@query(f"""WITH RECURSIVE {_PROGRAM}, {_NODES}, {_FRAMES}, {_LIVE}, {_sliced(se.CUT_NODES, "SELECT search, node, 0 FROM st WHERE d = 0")},
c AS (SELECT DISTINCT search, l.src AS node FROM s JOIN l ON l.dst = s.node WHERE kind IN ('dispatch', 'exception_flow')),
k AS (SELECT s.search, s.node, s.distance, n.file, n.line, n.end_line, n.kind NOT IN ('{_OBSERVES}') AS k, c.node IS NULL AS c, lower(split_part(symbol, '.', 2)) <> word AS w, n.file <> touched AS t, n.end_line - n.line AS span
  FROM s JOIN nodes n USING (node) JOIN frames USING (search) LEFT JOIN c ON c.search = s.search AND c.node = s.node WHERE n.file NOT LIKE 'tests/%'),
q AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY search, file, line, end_line ORDER BY distance, k, c, w, t, span, file, line, node) = 1)
SELECT search, CAST(row_number() OVER (PARTITION BY search ORDER BY distance, k, c, w, t, span, file, line, node) AS INTEGER) AS place, node, file, line, end_line, distance,
  'backward def-use path from first project failure frame' || CASE WHEN c THEN '' ELSE '; controls the failing observation' END || CASE WHEN w THEN '' ELSE '; overlaps issue/check symbol' END || CASE WHEN t THEN '' ELSE '; overlaps current working diff' END AS reasons
FROM q QUALIFY place <= {se.CUTS}""")
def ranked_repair_cuts(spark, sf_dir):
    """Five ranges for each failing part."""
    edges, nodes = program(spark, sf_dir)
    v = FRAMES.frame(spark, sf_dir)
    nodes = Rounds(spark, "program").put(nodes)
    words, changed = v.select("search", "word"), v.select("search", F.col("touched").alias("file"))
    member, starts = se.alike(_frames(spark, sf_dir).where("place = 0"), nodes, se.CUT_NODES, words, changed)
    own = lambda df: df.join(member.where("search = like"), "search", "left_semi")
    return se.of_members(se.ranked_cuts(edges, nodes, starts, own(words), own(changed), rq.is_excluded(F.col("file"))), member)


_BACK, _ON = "', '".join(ep.BACKWARD), "', '".join(ep.PATH)
_CALLERS = "(node LIKE 'c:%' AND node NOT LIKE '%1') OR node LIKE 'n:%' OR node LIKE 's:%'"
#: Orders are seeds, parts whose number ends with 7 or 5 are observed; suppliers reach parts past the orders.
_ENTRY = f"""{_PROGRAM}, w AS (SELECT * FROM e WHERE kind IN ('{_ON}')), k AS (SELECT * FROM e WHERE kind IN ('{_BACK}')),
seed AS (SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node LIKE 'o:%'), obs AS (SELECT DISTINCT dst AS node FROM e WHERE dst LIKE 'p:%7' OR dst LIKE 'p:%5'), ctl AS (SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE {_CALLERS}),
see AS (SELECT w.src AS seed, w.dst AS observation, w.edge_id AS e2, w.confidence AS c2 FROM w JOIN seed ON w.src = seed.node JOIN obs ON obs.node = w.dst),
up AS (SELECT a.dst AS seed, a.src AS entry, [a.edge_id] AS e1, a.confidence AS c1 FROM w a JOIN seed ON a.dst = seed.node UNION ALL SELECT a.dst, b.src, [b.edge_id, a.edge_id], a.confidence * b.confidence FROM w a JOIN seed ON a.dst = seed.node JOIN w b ON b.dst = a.src),
con AS (SELECT seed, entry, any_value(e1) AS e1, any_value(c1) AS c1 FROM up JOIN ctl ON ctl.node = up.entry WHERE seed IN (SELECT seed FROM see) GROUP BY ALL),
t(seed, node, cs) AS (SELECT node, node, CAST([] AS VARCHAR[]) FROM seed UNION SELECT t.seed, k.src, CASE WHEN k.condition = 'True' THEN t.cs ELSE list_sort(list_distinct(list_append(t.cs, k.condition))) END FROM t JOIN k ON k.dst = t.node
  WHERE (t.seed, t.node) NOT IN (SELECT (seed, entry) FROM con) AND NOT (list_contains(t.cs, 'big') AND list_contains(t.cs, 'not (big)'))),
ok AS (SELECT * FROM t WHERE NOT (list_contains(cs, 'big') AND list_contains(cs, 'not (big)'))),
way AS (SELECT con.seed, entry, observation, cs, list_append(e1, e2) AS edges, c1 * c2 AS confidence FROM ok JOIN con ON con.seed = ok.seed AND con.entry = ok.node JOIN see ON see.seed = con.seed)"""


@query(f"""WITH RECURSIVE {_ENTRY}, by1 AS (SELECT DISTINCT way.seed, way.entry, way.observation FROM way JOIN w a ON a.src = way.entry JOIN w b ON b.src = a.dst AND b.dst = way.observation WHERE a.dst <> way.seed),
by2 AS (SELECT DISTINCT way.seed, way.entry, way.observation FROM way JOIN w a ON a.src = way.entry JOIN w b ON b.src = a.dst JOIN w c ON c.src = b.dst AND c.dst = way.observation WHERE b.dst <> way.seed AND a.dst <> way.seed)
SELECT 'PATH' AS kind, seed, entry, observation, CASE WHEN len(cs) = 0 THEN 'True' ELSE array_to_string(list_transform(cs, lambda c: '(' || c || ')'), ' and ') END AS path_condition, array_to_string(edges, ' ') AS edges, CAST(len(edges) AS BIGINT) AS n_edges, confidence,
  CAST(CASE WHEN (seed, entry, observation) IN (SELECT (seed, entry, observation) FROM by1) THEN 2 WHEN (seed, entry, observation) IN (SELECT (seed, entry, observation) FROM by2) THEN 3 END AS BIGINT) AS bypass FROM way
UNION ALL SELECT 'ENTRYPOINT_NOT_CONFIRMED', node, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM seed WHERE node NOT IN (SELECT seed FROM way)
UNION ALL SELECT 'INFEASIBLE', NULL, node, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT node FROM t WHERE list_contains(cs, 'big') AND list_contains(cs, 'not (big)'))""")
def recovered_entrypoints(spark, sf_dir):
    """All orders back to who can call them, and on to what is observed; orders without a confirmed path, and nodes that
    conditions rule out."""
    edges, nodes = program(spark, sf_dir)
    edges = edges.withColumn("pos", F.lit(0)).withColumn("evidence", F.array("kind"))
    nodes = Rounds(spark, "program").put(nodes.select("node"))
    got = ep.recover_entrypoints(edges, nodes.withColumn("controllable", F.expr(_CALLERS)), nodes.where("node like 'o:%'"), nodes.where("node like 'p:%7' or node like 'p:%5'"))
    paths = got.paths.select(F.lit("PATH").alias("kind"), "seed", "entry", "observation", "path_condition", F.array_join("edges", " ").alias("edges"), "n_edges", "confidence", "bypass")
    return paths.unionByName(got.frontiers, True).unionByName(got.infeasible.select(F.lit("INFEASIBLE").alias("kind"), F.col("node").alias("entry")), True)
