"""Diffs, frames, slices and budgets: hunks of unified diffs, a failure's first frame, files that fit, tests that relate.

Null booleans count as false; null texts are empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, quoted, stable_id
from .gates import yes
from .graph import hops

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
FRAME = r"""File ["']([^"']+)["'], line (\d+), in ([^\n]+)"""
LOCATION = r"(?m)^((?:[A-Za-z]:)?[^\s:]+\.py):(\d+):"
#: Roles that may spend, and those of generators; parts of shared folders.
ROLES = ["semantic", "graph", "initial-generator", "repair-generator", "challenge-materializer", "discriminator", "executor", "tracer", "cleanup"]
GENERATORS = ["initial-generator", "repair-generator"]
SHARED = ["utils", "util", "common", "shared"]


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """diff, file, place, hunk, old_start, old_count, new_start, new_count, added, deleted (arrays of lines, in order).

    diffs: diff, file, text (a file's unified diff). A line belongs to the last header above it; what stands before the
    first is left out. A count that isn't given is 1.
    """
    lines = diffs.select("diff", "file", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    head = F.col("line").rlike(HUNK)
    upto = Window.partitionBy("diff", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", head).withColumn("place", F.sum(F.col("head").cast("int")).over(upto)).where("place > 0")
    kept = lambda mark: ~F.col("head") & F.startswith("line", F.lit(mark)) & ~F.startswith("line", F.lit(mark * 3))
    body = lambda mark: F.transform(F.array_sort(F.collect_list(F.when(kept(mark), F.struct("n", F.substring("line", F.lit(2), F.length("line")).alias("t"))))), lambda x: x["t"])
    got = rows.groupBy("diff", "file", "place").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("h"), body("+").alias("added"), body("-").alias("deleted"))
    number = lambda k: F.regexp_extract("h", HUNK, k)
    count = lambda k: F.when(number(k) == "", 1).otherwise(number(k).cast("long")).cast("long")
    out = got.select("diff", "file", F.col("place").cast("int").alias("place"), number(1).cast("long").alias("old_start"), count(2).alias("old_count"), number(3).cast("long").alias("new_start"), count(4).alias("new_count"), "added", "deleted")
    kind = out.schema["added"].dataType
    own = stable_id(F.lit("diff-hunk"), quoted(F.col("file")), F.col("old_start").cast("string"), F.col("new_start").cast("string"), canonical_json(F.col("added"), kind), canonical_json(F.col("deleted"), kind))
    return out.withColumn("hunk", own)


def first_project_frame(runs: DataFrame, root: str) -> DataFrame:
    """run, file, line, symbol: the last frame of a run's output inside the project, tests only if nothing else is.

    runs: run, output. Paths below `root`, or relative ones, are the project's. Without traceback frames, lines of the
    form file.py:12: count, with the symbol <failure>.
    """
    triple = lambda p, n: F.arrays_zip(*[F.regexp_extract_all("output", F.lit(p), F.lit(k)).alias(f"g{k}") for k in range(1, n + 1)])
    inside = F.concat(F.lit(root.rstrip("/")), F.lit("/"))
    relative = lambda path: F.when(F.startswith(path, inside), F.substring(path, F.length(inside) + 1, F.length(path))).when(~F.startswith(path, F.lit("/")), path)
    frame = lambda path, line, symbol: F.struct(relative(path).alias("file"), line.cast("long").alias("line"), symbol.alias("symbol"))
    known = lambda frames: F.filter(frames, lambda x: x["file"].isNotNull())
    traced = known(F.transform(triple(FRAME, 3), lambda x: frame(x["g1"], x["g2"], F.trim(x["g3"]))))
    told = known(F.transform(triple(LOCATION, 2), lambda x: frame(x["g1"], x["g2"], F.lit("<failure>"))))
    rows = runs.select("run", traced.alias("traced"), told.alias("told")).withColumn("frames", F.when(F.size("traced") > 0, F.col("traced")).otherwise(F.col("told")))
    is_test = lambda x: F.array_contains(F.split(x["file"], "/"), "tests") | F.startswith(F.substring_index(x["file"], "/", -1), F.lit("test_"))
    own = F.filter("frames", lambda x: ~is_test(x))
    last = F.when(F.size(own) > 0, F.element_at(own, -1)).when(F.size("frames") > 0, F.element_at("frames", -1))
    return rows.select("run", last.alias("x")).where("x is not null").select("run", "x.*")


def admit_files(files: DataFrame, limits: dict[str, int]) -> DataFrame:
    """slice, file, admitted: files in order, each taken if it still fits; one that doesn't is passed over, and later
    ones may fit. files: slice, place, file, nodes, edges, functions. limits: files, nodes, edges, functions.

    What fits depends on all taken before, so each slice is one task; a slice is a set of files of one repository.
    """
    kind = {f.name: f.dataType.simpleString() for f in files.schema}

    def take(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("place", "file", "nodes", "edges", "functions")], strict=True), key=lambda r: r[0])
        used, got = [0, 0, 0, 0], {}
        caps = [limits["files"], limits["nodes"], limits["edges"], limits["functions"]]
        for _, file, *cost in rows:
            new = [u + c for u, c in zip(used, [1, *cost], strict=True)]
            if file not in got:
                got[file] = all(n <= cap for n, cap in zip(new, caps, strict=True))
                used = new if got[file] else used
        own = pa.array(table.column("slice").to_pylist()[:1] * len(got), table.schema.field("slice").type)
        return pa.table({"slice": own, "file": pa.array(list(got), table.schema.field("file").type), "admitted": pa.array(list(got.values()), pa.bool_())})

    return files.groupBy("slice").applyInArrow(take, f"slice {kind['slice']}, file {kind['file']}, admitted boolean")


def related_tests(issues: DataFrame, references: DataFrame, visible: DataFrame, most: int = 20) -> DataFrame:
    """issue, path, place: tests that refer to an issue's words, the best `most` (the rule's own limit).

    issues: issue, token (lower case); references: path, name; visible: issue, path (these aren't named again). Ranked by
    the length of tokens that the path holds, of shared names of eight letters or more, then by their number.
    """
    names = references.select("path", F.lower("name").alias("token")).distinct()
    tokens = issues.select("issue", "token").distinct()
    shared = tokens.join(names, "token").groupBy("issue", "path").agg(F.sum(F.when(F.length("token") >= 8, F.length("token")).otherwise(0)).alias("long"), F.count("*").alias("n"))
    shared = shared.join(visible, ["issue", "path"], "left_anti").withColumn("compact", F.regexp_replace(F.lower("path"), "[^a-z0-9]", ""))
    words = tokens.where(F.length("token") >= 5).groupBy("issue").agg(F.collect_list("token").alias("words"))  # of one issue's text
    fits = F.aggregate(F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.contains(F.col("compact"), w)), F.lit(0), lambda a, w: a + F.length(w))
    rows = shared.join(words, "issue", "left").withColumn("fits", fits)
    place = F.row_number().over(Window.partitionBy("issue").orderBy(F.desc("fits"), F.desc("long"), F.desc("n"), "path"))
    return rows.select("issue", "path", place.alias("place")).where(F.col("place") <= most)


def state_deficit(targets: DataFrame, comparisons: DataFrame) -> DataFrame:
    """state, deficit: targets that the last comparison doesn't show as fixed. targets: state, check_id; comparisons:
    state, seq, check_id, class."""
    last = comparisons.groupBy("state", "check_id").agg(F.max_by("class", "seq").alias("class"))
    rows = targets.select("state", "check_id").distinct().join(last, ["state", "check_id"], "left")
    return rows.groupBy("state").agg(F.count_if(~yes(F.col("class") == "TARGET_FIXED")).alias("deficit"))


def charge(ledgers: DataFrame, charges: DataFrame, reserve: float = 0.7) -> DataFrame:
    """ledger, request, verdict, left: charges in order, with what is left after them. ledgers: ledger, tokens (of
    generators), other; charges: ledger, seq, request, role, tokens, other.

    A charge is refused for an unknown role, a request that came before, for more than is left, or (roles that don't
    generate) once generators have less than their reserve. A refused charge costs nothing, so each ledger is one task.
    """
    kind = {f.name: f.dataType.simpleString() for f in charges.schema}
    rows = charges.join(ledgers.select("ledger", F.col("tokens").alias("all_tokens"), F.col("other").alias("all_other")), "ledger")

    def run(table: pa.Table) -> pa.Table:
        got = sorted(zip(*[table.column(c).to_pylist() for c in ("seq", "ledger", "request", "role", "tokens", "other", "all_tokens", "all_other")], strict=True), key=lambda r: r[0])
        tokens, other, seen, out = float(got[0][6]), float(got[0][7]), set(), []
        for _, ledger, request, role, t, o, *_ in got:
            if role not in ROLES:
                verdict = "UNKNOWN_ROLE"
            elif request in seen:
                verdict = "DUPLICATE"
            elif role not in GENERATORS and tokens < reserve * float(got[0][6]):
                verdict = "RESERVE"
            elif t > tokens or o > other:
                verdict = "EXHAUSTED"
            else:
                verdict, tokens, other = "CHARGED", tokens - t, other - o
                seen.add(request)
            out.append((ledger, request, verdict, tokens, other))
        cols = list(zip(*out, strict=True))
        types = [table.schema.field("ledger").type, table.schema.field("request").type, pa.string(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("ledger", "request", "verdict", "tokens_left", "other_left"), cols, types, strict=True)})

    return rows.groupBy("ledger").applyInArrow(run, f"ledger {kind['ledger']}, request {kind['request']}, verdict string, tokens_left double, other_left double")


def tree_digest(files: DataFrame) -> DataFrame:
    """tree, digest: hash over a tree's files in the order of their paths. files: tree, path, content_hash. One row per
    file of one tree meets in a group, without contents."""
    line = F.concat("path", F.lit("\n"), "content_hash", F.lit("\n"))
    return files.groupBy("tree").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), ""), 256).alias("digest"))


def path_tree(edges: DataFrame, start: DataFrame, forward: bool = True) -> DataFrame:
    """node, hops, parent, edge_id: a shortest-path tree; of several parents the one with the least (edge, name)."""
    far = hops(edges, start, forward=forward)
    here, there = ("src", "dst") if forward else ("dst", "src")
    steps = edges.join(far.select(F.col("node").alias(here), F.col("hops").alias("h0")), here).join(far.select(F.col("node").alias(there), F.col("hops").alias("h1")), there).where("h1 = h0 + 1")
    best = steps.groupBy(F.col(there).alias("node")).agg(F.min(F.struct("edge_id", F.col(here).alias("parent"))).alias("x")).select("node", "x.parent", "x.edge_id")
    return far.join(best, "node", "left").select("node", F.col("hops").cast("int").alias("hops"), "parent", "edge_id")


def resolve_oracle(authority: Column, authority_class: Column, kind: Column, keeps: Column, exception_type: Column, has_literal: Column, same_input: Column, formula: Column) -> Column:
    """struct(kind, relation, lifecycle): what a requirement's leaf can be held against."""
    trusted = authority.isin("A", "B", "C")
    low = F.lower(formula)
    ordered = formula.rlike("(?i)\\bbefore\\b.*\\bafter\\b|\\bmust\\s+(?:precede|follow)\\b")
    out = lambda name, relation, runs: F.struct(F.lit(name).alias("kind"), (relation if isinstance(relation, Column) else F.lit(relation)).alias("relation"), F.when(yes(runs), "ACTIVE").otherwise("DOWNGRADED").alias("lifecycle"))
    return (
        F.when((authority_class == "PRESERVATION") | yes(keeps), out("BASELINE_DIFFERENTIAL", "preservation", F.lit(True)))
        .when((kind == "exception") & yes(exception_type != ""), out("EXPLICIT_EXCEPTION", "exception", trusted))
        .when((kind == "equality") & yes(has_literal), out("EXPLICIT_RELATION", "equality", trusted))
        .when((kind == "equality") & yes(same_input), out("EXPLICIT_RELATION", "input_identity", trusted))
        .when((kind == "temporal") & trusted & ordered, out("RELATION_ORACLE", "temporal", F.lit(True)))
        .when((kind == "metamorphic") & trusted, out("METAMORPHIC", "idempotence", F.contains(low, F.lit("idempotent"))))
        .otherwise(out("EXPLORATION_ONLY", kind, F.lit(False)))
    )


def same_symbol(a: Column, b: Column) -> Column:
    dot = lambda x: F.concat(x, F.lit("."))
    tail = lambda x: F.concat(F.lit("."), x)
    return (a != "") & (b != "") & ((a == b) | F.startswith(a, dot(b)) | F.startswith(b, dot(a)) | F.endswith(a, tail(b)) | F.endswith(b, tail(a)))


def accept_edit_scope(files: Column, cut_ids: Column, cut_files: Column, cut_symbols: Column, symbols: Column, executions: Column, mechanical: Column, changed: Column, relations: Column) -> Column:
    """struct(allowed, touched, unexplained_files, unexplained_symbols): may this edit be made by this action?

    Arrays: files and symbols that the action names, ids, files and symbols of its cuts, executions that failed; changed
    files; relations: structs (id, scope, kind). mechanical: was the failure one of the patch itself?
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    allowed_files, allowed_symbols = F.array_union(files, cut_files), F.array_union(symbols, cut_symbols)
    scopes = F.array_distinct(F.filter(F.transform(relations, lambda r: r["scope"]), lambda s: s != ""))
    meets = lambda xs: F.exists(scopes, lambda a: F.exists(xs, lambda b: same_symbol(a, b)))
    direct = F.exists(relations, lambda r: F.array_contains(cut_ids, r["id"])) | F.arrays_overlap(changed, cut_files) | meets(cut_symbols)
    by_failure = some(cut_ids) & some(executions) & meets(allowed_symbols)
    by_files = yes(mechanical) & some(allowed_files) & some(changed) & (F.size(F.array_except(changed, allowed_files)) == 0)
    touched = yes(direct) | yes(by_failure) | yes(by_files)
    lost_files = F.when(some(allowed_files), F.array_sort(F.array_except(changed, allowed_files))).otherwise(F.array().cast("array<string>"))
    lost_symbols = F.when(some(allowed_symbols), F.array_sort(F.filter(scopes, lambda a: ~F.exists(allowed_symbols, lambda b: same_symbol(a, b))))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(relations, lambda r: F.lower(r["kind"]))
    privileged = F.exists(kinds, lambda k: k.rlike("public|signature|base_class|inheritance|mro"))
    shared = F.exists(changed, lambda f: F.arrays_overlap(F.split(f, "/"), F.array(*map(F.lit, SHARED))) & ~F.array_contains(allowed_files, f))
    risky = (F.size(lost_files) > 0) | (F.size(lost_symbols) > 0) | yes(shared) | (yes(privileged) & ~some(executions))
    return F.struct((touched & ~risky).alias("allowed"), touched.alias("touched"), lost_files.alias("unexplained_files"), lost_symbols.alias("unexplained_symbols"))


def graph_digest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """by, n, digest: of a graph's rows whatever their order: a sum of their hashes in three numbers, so that nothing is
    gathered. rows: by, key (a text that names a row with its content)."""
    digest = F.sha2(key, 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, k, 12), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.concat_ws("-", *[part(k).cast("string") for k in (1, 13, 25)]).alias("digest"))
