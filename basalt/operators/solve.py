"""Constraint solving over tables of rows, in Arrow batches: each row is a small finite search, none needs a shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constraints as cs
from ..functions import domains as dm

for _module in (cs, dm):  # executors need not have this package
    cloudpickle.register_pickle_by_value(_module)
ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _rowwise(df: DataFrame, columns: list[str], key: str, act: Callable[..., tuple], schema: dict[str, str]) -> DataFrame:
    """key and what act makes of the columns of each row."""
    rows = df.select(key, *columns)
    kind, types, names = rows.schema[key].dataType.simpleString(), [ARROW[t] for t in schema.values()], list(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [act(*row) for row in zip(*[batch.column(i + 1).to_pylist() for i in range(len(columns))], strict=True)]
            cols = list(zip(*got, strict=True)) or [() for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[key, *names])

    return rows.mapInArrow(run, ", ".join([f"{key} {kind}", *[f"{n} {t}" for n, t in schema.items()]]))


def solve_constraints(rows: DataFrame, key: str, cap: int = cs.CAP) -> DataFrame:
    """key, satisfiable, witness, tried, reason, complete.

    rows: key, variables array<struct<name, domain>>, domains array<struct<domain, literals array<string>, types
    array<string>, lower long, upper long, is_open boolean>>, constraints array<string>. Literals are Python literals.
    The witness is `name=value` by name, joined by `;`. Null lists are empty.
    """

    def act(variables, domains, constraints):
        known = {d["domain"]: (cs.values_of(d["literals"] or [], d["types"] or [], d["lower"], d["upper"]), bool(d["is_open"])) for d in domains or []}
        ok, witness, tried, reason, complete = cs.solve([(v["name"], v["domain"]) for v in variables or []], known, constraints or [], cap)
        return ok, None if witness is None else ";".join(f"{n}={witness[n]!r}" for n in sorted(witness)), tried, reason, complete

    return _rowwise(rows, ["variables", "domains", "constraints"], key, act, {"satisfiable": "boolean", "witness": "string", "tried": "long", "reason": "string", "complete": "boolean"})


def infer_domains(rows: DataFrame, key: str) -> DataFrame:
    """key, name, types, literals: a row per variable. rows: key, formula, names array<string>."""

    def act(formula, names):
        found = cs.infer(formula or "", names or [])
        return [n for n, _, _ in found], [",".join(t) for _, t, _ in found], [";".join(map(repr, v)) for _, _, v in found]

    out = _rowwise(rows, ["formula", "names"], key, act, {"name": "array<string>", "types": "array<string>", "literals": "array<string>"})
    return out.select(key, F.inline(F.arrays_zip("name", "types", "literals")))


def guard_feasibility(rows: DataFrame, key: str, cap: int = cs.CAP) -> DataFrame:
    """key, feasible, reason. rows: key, guards array<string>."""
    return _rowwise(rows, ["guards"], key, lambda guards: cs.guard_feasible(guards or [], cap), {"feasible": "boolean", "reason": "string"})


def predicate_names(rows: DataFrame, key: str) -> DataFrame:
    """key, names: of all predicates that parse. rows: key, predicates array<string>."""
    return _rowwise(rows, ["predicates"], key, lambda p: (cs.names_of(p or []),), {"names": "array<string>"})


def preconditions(rows: DataFrame, key: str) -> DataFrame:
    """key, is_expression of a condition's text (null: no). rows: key, condition."""
    return _rowwise(rows, ["condition"], key, lambda c: (c is not None and cs.is_expression(c),), {"is_expression": "boolean"})


def scenario_partitions(leaves: DataFrame, key: str, cap: int = cs.CAP) -> DataFrame:
    """key, place, constraint, and what solving it gives, with `covers`: complete, and no domain is open.

    leaves: key, variables, domains (as in solve_constraints), precondition, guards array<string>. A leaf has its
    precondition (unless True), then the partitions of each guard, else True.
    """
    none = F.array().cast("array<string>")
    own = F.when(F.coalesce("precondition", F.lit("True")).isin("", "True"), none).otherwise(F.array("precondition"))
    parts = F.concat(own, F.flatten(F.transform("guards", dm.branch_partitions)))
    rows = leaves.select(key, "variables", "domains", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("True")))).alias("place", "constraint"))
    rows = rows.withColumn("__k", F.struct(F.col(key).alias("key"), "place", "constraint", F.exists("domains", lambda d: F.coalesce(d["is_open"], F.lit(False))).alias("open")))
    solved = solve_constraints(rows.select("__k", "variables", "domains", F.array("constraint").alias("constraints")), "__k", cap)
    return solved.select(F.col("__k.key").alias(key), "__k.place", "__k.constraint", "satisfiable", "witness", "reason", "complete", (F.col("complete") & ~F.col("__k.open")).alias("covers"))


def expected_values(rows: DataFrame, key: str) -> DataFrame:
    """key, found, expected (canonical JSON; null if not found). rows: key, formula."""

    def act(formula):
        found, value = cs.expected_value(formula or "")
        try:
            text = json.dumps(cs.comparable(value), ensure_ascii=True, sort_keys=True, separators=(",", ":"), allow_nan=False) if found else None
        except (TypeError, ValueError):  # no JSON for it, as for complex numbers
            return False, None
        return found, text

    return _rowwise(rows, ["formula"], key, act, {"found": "boolean", "expected": "string"})


#: What a claim's authority is worth. Fixed values.
WORTH = {"A": 5.0, "B": 3.0, "C": 2.0}


def enumerate_assignments(claims: DataFrame, refutes: DataFrame, most: int = 32) -> DataFrame:
    """graph, place, choices (array, a claim or `?` by subject), score, complete: coherent readings of a graph's
    hypotheses, best first, by beam search over its subjects.

    claims: graph, claim, kind (SEMANTIC_HYPOTHESIS, NORMATIVE_REQUIREMENT or another), subject, authority, clusters
    array<string>; refutes: graph, a, b. Each subject takes one of its hypotheses or none (`?`, which costs 1). A reading
    is incoherent if it holds two hypotheses, or a hypothesis and a trusted requirement, that refute each other. complete:
    no subject with a trusted hypothesis is left open. A beam keeps four times `most` readings, 16 at least (the rule's
    own limits). A graph is one task; its readings are bounded by the beam.
    """
    kind = claims.schema["graph"].dataType.simpleString()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {r["claim"]: r for r in left.to_pylist()}
        clash: dict[str, set[str]] = {}
        for r in right.to_pylist():
            clash.setdefault(r["a"], set()).add(r["b"])
            clash.setdefault(r["b"], set()).add(r["a"])
        hypothesis = lambda c: rows[c]["kind"] == "SEMANTIC_HYPOTHESIS"
        fixed = {c for c, r in rows.items() if r["kind"] == "NORMATIVE_REQUIREMENT" and r["authority"] in WORTH}
        subjects: dict[str, list[str]] = {}
        for c in sorted(rows):
            if hypothesis(c):
                subjects.setdefault(rows[c]["subject"] or "", []).append(c)

        def worth(choices: tuple[str, ...]) -> float:
            held = [c for c in choices if c != "?"]
            clusters = {x for c in held for x in rows[c]["clusters"] or []}
            return sum(WORTH.get(rows[c]["authority"], 0.5) for c in held) - (len(choices) - len(held)) + 0.25 * len(clusters)

        def order(choices: tuple[str, ...]) -> tuple:
            return -worth(choices), choices.count("?"), choices

        beam: list[tuple[str, ...]] = [()]
        for subject in sorted(subjects):
            wider = [(*p, c) for p in beam for c in [*subjects[subject], "?"] if c == "?" or not clash.get(c, set()) & (fixed | {x for x in p if x != "?"})]
            beam = sorted(wider, key=order)[: max(4 * most, 16)]
        names = sorted(subjects)
        best = sorted(beam, key=lambda p: (-worth(p), p))[:most] if names else []
        done = [all(c != "?" or not any(rows[x]["authority"] in WORTH for x in subjects[s]) for s, c in zip(names, p, strict=True)) for p in best]
        n = len(best)
        own = pa.array([key[0].as_py()] * n, left.schema.field("graph").type)
        return pa.table({"graph": own, "place": pa.array(range(1, n + 1), pa.int32()), "choices": pa.array([list(p) for p in best], pa.list_(pa.string())), "score": pa.array(map(worth, best), pa.float64()), "complete": pa.array(done, pa.bool_())})

    return claims.groupBy("graph").cogroup(refutes.groupBy("graph")).applyInArrow(run, f"graph {kind}, place int, choices array<string>, score double, complete boolean")
