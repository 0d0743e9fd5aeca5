"""Queries over ordered events, text, artifacts and snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .projections import ordered, table, trace

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT * FROM (SELECT user_id AS bundle, event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NOT NULL")
def merge_trace_edges(spark, sf_dir):
    rows = trace(spark, sf_dir).select("bundle", F.col("event_id").alias("node"), F.lag("event_id").over(ordered()).alias("previous"))
    return rows.where("previous is not null")


@query("""SELECT bundle, node, carried FROM (SELECT user_id AS bundle, event_id AS node,
  last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM events)""")
def trace_carry_forward(spark, sf_dir):
    """The last matched node before each event, carried over unmatched ones."""
    back = ordered().rowsBetween(Window.unboundedPreceding, -1)
    matched = F.when(F.col("kind") != "click", F.col("event_id"))
    return trace(spark, sf_dir).select("bundle", F.col("event_id").alias("node"), F.last(matched, ignorenulls=True).over(back).alias("carried"))


@query("""WITH s AS (SELECT user_id AS bundle, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
j AS (SELECT coalesce(a.bundle, b.bundle - 1) AS bundle, coalesce(a.pos, b.pos) AS pos, a.kind AS x, b.kind AS y FROM (SELECT * FROM s WHERE bundle % 2 = 0) a FULL JOIN (SELECT * FROM s WHERE bundle % 2 = 1) b ON a.bundle + 1 = b.bundle AND a.pos = b.pos)
SELECT bundle, min(pos) AS position FROM j WHERE x IS DISTINCT FROM y GROUP BY bundle""")
def first_divergence(spark, sf_dir):
    """Users 2k and 2k+1 as two runs: the first place where their events differ, or one has ended."""
    s = trace(spark, sf_dir).select("bundle", "kind", F.row_number().over(ordered()).alias("pos"))
    a = s.where("bundle % 2 = 0").select("bundle", "pos", F.col("kind").alias("x"))
    b = s.where("bundle % 2 = 1").select((F.col("bundle") - 1).alias("bundle"), "pos", F.col("kind").alias("y"))
    return a.join(b, ["bundle", "pos"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).groupBy("bundle").agg(F.min("pos").cast("long").alias("position"))


_ALLOWED = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")]


@query(f"""WITH p AS (SELECT user_id AS bundle, event_id, event_type AS target, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source FROM events)
SELECT bundle, event_id, source, target FROM p WHERE source IS NOT NULL AND (source, target) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in _ALLOWED)})""")
def phase_legality(spark, sf_dir):
    allowed = F.broadcast(spark.createDataFrame(_ALLOWED, "source string, target string"))  # a fixed table
    steps = trace(spark, sf_dir).select("bundle", "event_id", F.lag("kind").over(ordered()).alias("source"), F.col("kind").alias("target")).where("source is not null")
    return steps.join(allowed, ["source", "target"], "left_anti").select("bundle", "event_id", "source", "target")


@query("SELECT user_id AS bundle, arg_max(event_id, (ts, event_id)) AS promoted, count(*) AS n FROM (SELECT * FROM events WHERE value > 50) GROUP BY user_id")
def policy_replay(spark, sf_dir):
    """Ordered fold: the last event that the policy promotes."""
    hot = trace(spark, sf_dir).where("value > 50")
    return hot.groupBy("bundle").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("promoted"), F.count("*").alias("n"))


@query("SELECT user_id AS instance, event_type AS type, arg_max(event_id, (ts, event_id)) AS artifact, max(value) AS most FROM events GROUP BY ALL")
def artifact_latest(spark, sf_dir):
    return trace(spark, sf_dir).groupBy(F.col("bundle").alias("instance"), F.col("kind").alias("type")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("artifact"), F.max("value").alias("most"))


@query("SELECT event_id AS artifact, event_id + 7 AS parent FROM events WHERE event_id + 7 NOT IN (SELECT event_id FROM events WHERE event_type <> 'click')")
def artifact_integrity(spark, sf_dir):
    """Dangling parents of all claims, by anti-join."""
    e = trace(spark, sf_dir)
    stored = e.where("kind <> 'click'").select(F.col("event_id").alias("parent"))
    return e.select(F.col("event_id").alias("artifact"), (F.col("event_id") + 7).alias("parent")).join(stored, "parent", "left_anti").select("artifact", "parent")


@query("""SELECT coalesce(b.k, a.k) AS path, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM
 (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 5 <> 0) b FULL JOIN
 (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 3 <> 0) a ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def tree_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("b"))
    after = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 7 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").otherwise("modified")
    return before.join(after, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, -c_acctbal FROM customer WHERE c_custkey % 4 = 0")
def incremental_merge(spark, sf_dir):
    """Upsert: rows of changed keys are replaced."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.where("k % 4 = 0").withColumn("v", -F.col("v"))
    return c.join(new.select("k"), "k", "left_anti").unionByName(new)


@query("SELECT token, count(DISTINCT p_partkey) AS parts, min(p_partkey) AS first FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z_0-9]+')) AS token FROM part) GROUP BY token")
def token_inverted_index(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z_0-9]+"), 0)).alias("token"))
    return tokens.groupBy("token").agg(F.countDistinct("p_partkey").alias("parts"), F.min("p_partkey").alias("first"))


@query("""SELECT doc_id AS path, line, substr(content, 1, 500) AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
WHERE contains(lower(content), 'license') ORDER BY path, line LIMIT 100""")
def code_search(spark, sf_dir):
    """Case-insensitive search over lines; the first hundred by path and line are the report."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return lines.where(F.lower("content").contains("license")).select("path", (F.col("at") + 1).cast("long").alias("line"), F.substring("content", 1, 500).alias("content")).orderBy("path", "line").limit(100)


@query("SELECT doc_id AS path, count(*) AS lines, count(*) FILTER (length(content) = 0) AS blank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents) GROUP BY doc_id")
def file_line_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.explode(F.split("text", "\n")).alias("content"))
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.length("content") == 0).alias("blank"))


@query("""WITH spans AS (SELECT c_custkey AS file, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
points AS (SELECT o_custkey AS file, o_orderkey AS point, o_orderdate AS day FROM orders) SELECT file, point, CAST(epoch(hi) - epoch(lo) AS BIGINT) AS span FROM points JOIN spans USING (file) WHERE day BETWEEN lo AND hi AND day > lo""")
def range_join_spans(spark, sf_dir):
    """Points inside spans, per file: an equi-join on the file with the range as residual."""
    o = table(spark, sf_dir, "orders")
    spans = o.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_custkey").alias("file")).agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    points = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("point"), F.col("o_orderdate").alias("day"))
    return points.join(spans, "file").where("day between lo and hi and day > lo").select("file", "point", (seconds("hi") - seconds("lo")).cast("long").alias("span"))


_WIDE = 400


@query("""WITH n AS (SELECT user_id AS file, event_id AS node, event_id AS lo, event_id + (event_id % 400) AS hi FROM events), p AS (SELECT user_id AS file, event_id AS point FROM events)
SELECT file, point, arg_min(node, (hi - lo, lo)) AS enclosing FROM p JOIN n USING (file) WHERE point BETWEEN lo AND hi GROUP BY ALL""")
def enclosing_location(spark, sf_dir):
    """The innermost span of the same file that holds a point. Spans are cut into range buckets, so that a point of a hot
    file meets only spans near it."""
    e = trace(spark, sf_dir)
    bucket = lambda c: F.floor(F.col(c) / _WIDE)
    spans = e.select(F.col("bundle").alias("file"), F.col("event_id").alias("node"), F.col("event_id").alias("lo"), (F.col("event_id") + F.col("event_id") % 400).alias("hi"))
    spans = spans.where("lo <= hi").withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    points = e.select(F.col("bundle").alias("file"), F.col("event_id").alias("point")).withColumn("bucket", bucket("point"))
    inside = points.join(spans, ["file", "bucket"]).where("point between lo and hi")
    return inside.groupBy("file", "point").agg(F.min_by("node", F.struct(F.col("hi") - F.col("lo"), "lo")).alias("enclosing"))


_RECENT = "CAST(round_even(3.0 * (turn - lo) / greatest(hi - lo, 1), 0) AS BIGINT)"


@query(f"""WITH m AS (SELECT conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi FROM conversations),
s AS (SELECT conv_id, turn, length(text) AS n, 2 * len(regexp_extract_all(text, '[A-Z][a-z]+')) + {_RECENT} AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS place, sum(n) OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS used FROM s)
SELECT conv_id, turn, CAST(score AS BIGINT) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8 AND used <= 6000""")
def discussion_rank(spark, sf_dir):
    """Turns by relevance, later ones first among equals, within a budget of characters. Rounds half to even."""
    conv = Window.partitionBy("conv_id")
    rank = conv.orderBy(F.desc("score"), F.desc("turn"))
    lo, hi = F.min("turn").over(conv), F.max("turn").over(conv)
    recent = F.bround(F.lit(3.0) * (F.col("turn") - lo) / F.greatest(hi - lo, F.lit(1)), 0).cast("long")
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (2 * F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)) + recent).alias("score"))
    r = s.withColumn("place", F.row_number().over(rank)).withColumn("used", F.sum("n").over(rank))
    return r.where("place <= 8 and used <= 6000").select("conv_id", "turn", F.col("score").cast("long").alias("score"), "place")


@query("SELECT * FROM (VALUES ('pkg.api.public', 0), ('api.public', 0), ('public', 0), ('helper', 1), ('core.helper', 1)) v(asked, symbol)")
def resolve_symbol(spark, sf_dir):
    """Exact name first; else, by tail, names that end with the dotted form."""
    symbols = spark.createDataFrame([(0, "pkg.api.public"), (1, "pkg.core.helper")], "symbol int, name string")
    asked = spark.createDataFrame([("pkg.api.public",), ("api.public",), ("public",), ("helper",), ("core.helper",), ("nothing",)], "asked string")
    tail = lambda c: F.element_at(F.split(c, "\\."), -1)
    exact = asked.join(symbols, F.col("asked") == F.col("name")).select("asked", "symbol")
    rest = asked.join(exact.select("asked"), "asked", "left_anti").withColumn("t", tail("asked"))
    by_tail = rest.join(symbols.withColumn("t", tail("name")), "t").where(F.endswith(F.col("name"), F.concat(F.lit("."), F.col("asked"))))
    return exact.unionByName(by_tail.select("asked", "symbol"))


@query("SELECT user_id AS bundle, count(DISTINCT event_type) = 1 AS stable, count(*) AS runs FROM events GROUP BY user_id")
def bundle_stability(spark, sf_dir):
    """Stable if all runs have one signature."""
    return trace(spark, sf_dir).groupBy("bundle").agg((F.countDistinct(F.sha2("kind", 256)) == 1).alias("stable"), F.count("*").alias("runs"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def envelope_payload(spark, sf_dir):
    return trace(spark, sf_dir).select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("SELECT event_type AS signature, count(*) AS n, count(DISTINCT user_id) AS owners, min(event_id) AS first FROM events GROUP BY event_type")
def failure_history(spark, sf_dir):
    return trace(spark, sf_dir).groupBy(F.col("kind").alias("signature")).agg(F.count("*").alias("n"), F.countDistinct("bundle").alias("owners"), F.min("event_id").alias("first"))


@query("SELECT l_partkey AS decision, count(DISTINCT l_returnflag) AS choices FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def discriminator_probes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("decision")).agg(F.countDistinct("l_returnflag").alias("choices")).where("choices > 1")
