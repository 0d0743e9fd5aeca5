"""Canonical JSON, constraints, evidence and run texts against Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from basalt.functions import canonical as cj
from basalt.functions import constraints as cs
from basalt.functions import runs as rn
from basalt.functions import text as tx
from basalt.operators import evidence as ev

TEXTS = ["", "plain", 'q"b\\s', "tab\tline\nret\rbell\x07del\x7f", "é ß 日本 🎉  ", "\x00\x1f", "a" * 3000 + "é"]
NUMBERS = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-4, 1.5e-4, 1e-5, 1.25e-7, 123456789.0, 1e15, 1e16, 1.5e300, 5e-324, 0.001, 12345.678, 1e7, 9.999999e6]


def test_canonical_json_equals_python(spark):
    rows = [(i, t, {"b": True, "a": False, "é": None}, [1, None, 3], (t, None)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, t string, m map<string,boolean>, l array<int>, s struct<z:string,a:int>")
    kind = df.schema
    got = df.select("id", *[cj.canonical_json(F.col(f.name), f.dataType).alias(f.name) for f in kind.fields if f.name != "id"]).collect()
    dump = lambda v: json.dumps(v, ensure_ascii=True, sort_keys=True, separators=(",", ":"))
    for r in got:
        i, t, m, xs, (z, a) = rows[r.id]
        assert (r.t, r.m, r.l, r.s) == (dump(t), dump(m), dump(xs), dump({"z": z, "a": a}))


def test_numbers_equal_python(spark):
    rng = random.Random(3)
    xs = NUMBERS + [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 20) for _ in range(200)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", cj.number(F.col("x")).alias("n")).collect()
    assert all(float(r.n) == xs[r.i] for r in got)
    assert {r.i: r.n for r in got if r.i < len(NUMBERS) and xs[r.i] != 5e-324} == {i: repr(x) for i, x in enumerate(NUMBERS) if x != 5e-324}
    assert spark.createDataFrame([(float("nan"),)], "x double").select(cj.number(F.col("x"))).first()[0] is None


def test_stable_ids(spark):
    row = spark.range(1).select(cj.stable_id(F.lit("a b/é_1"), cj.quoted(F.lit("ü")), F.lit("7")).alias("id"), cj.as_set(F.array(F.lit("b"), F.lit("a")), spark.createDataFrame([("",)], "x string").schema["x"].dataType).alias("s")).first()
    assert row.id == "a-b-é_1-" + hashlib.sha256(json.dumps(["ü", 7], separators=(",", ":")).encode()).hexdigest()[:24] and row.s == '["a","b"]'


@pytest.mark.parametrize("text,env,want", [
    ("x > 1 and not y", {"x": 2, "y": 0}, True), ("1 < x <= 3", {"x": 3}, True), ("x in (1, 2)", {"x": 2}, True), ("len(x) == 0", {"x": []}, True), ("len(x) == 0", {"x": 3}, False),
    ("isinstance(x, int) and -x < 0", {"x": 5}, True), ("x[0] == 'a'", {"x": {0: "a"}}, True), ("x[1:] == [2]", {"x": [1, 2]}, True), ("missing", {}, False), ("", {}, True), ("x is None or x.real == 1", {"x": 1}, True), ("{'k': x} == {'k': 1}", {"x": 1}, True),
])
def test_constraints_run(text, env, want):
    assert cs.compile_constraint(text)(env) is want


@pytest.mark.parametrize("text", ["x + 1", "open('f')", "x.__class__", "[i for i in x]", "lambda: 1", "f(x)", "len(x=1)", "x ==", "~x"])
def test_constraints_refuse(text):
    with pytest.raises((SyntaxError, ValueError)):
        cs.compile_constraint(text)


def test_solver_order_and_cap():
    many = {"d": (list(range(100)), True)}
    assert cs.solve([("a", "d"), ("b", "d")], many, ["a == 1", "b == 2"]) == (True, {"a": 1, "b": 2}, 103, "finite_domain_witness", True)
    assert cs.solve([("a", "d"), ("b", "d")], many, ["a == 99"]) == (False, None, 4096, "finite_domain_cap_exceeded", False)
    assert cs.solve([], {}, ["False"]) == (False, None, 1, "finite_domain_exhausted", True)
    assert [repr(v) for v in cs.values_of(["1", "True"], ["set", "bool"], 1, None)] == ["1", "True", "set()", "{0}", "False", "2"]


def test_segments(spark):
    texts = [("a", "One. Two? three\nfour\n\n- item\nlast"), ("b", "```\ncode.\n\nmore\n```\nafter"), ("c", "text\n```\nopen"), ("d", ""), ("e", None), ("f", "\n\n  \n")]
    got = ev.segments(spark.createDataFrame(texts, "key string, text string"), "key", "text").orderBy("key", "place").collect()
    assert [(r.key, r.start_line, r.end_line, r.rule[0], r.content) for r in got] == [
        ("a", 1, 1, "c", "One."), ("a", 1, 1, "c", "Two?"), ("a", 1, 2, "c", "three\nfour"), ("a", 4, 4, "c", "- item"), ("a", 5, 5, "c", "last"),
        ("b", 1, 5, "f", "```\ncode.\n\nmore\n```"), ("b", 6, 6, "c", "after"), ("c", 1, 1, "c", "text"), ("c", 2, 3, "c", "```\nopen"),
    ]


def test_polarity(spark):
    rows = [("x must not be None.", "x be none", True), ("x is  Never\nset", "x is set", True), ("a != b", "a b", False), ("plain . ", "plain", False)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", tx.polarity_base(F.col("t")).alias("b"), tx.is_negative(F.col("t")).alias("n")).collect()
    assert {(r.b, r.n) for r in got} == {(b, n) for _, b, n in rows}


def test_failure_signatures(spark):
    runs = [(0, "FAIL", 1, 'File "/a/b.py", line 12\nx in 0.31s', ""), (1, "FAIL", 1, 'File "/c/d.py", line 99\nx in 7s', ""), (2, "FAIL", 2, "other", None), (3, "PASS", 0, "x", "")]
    df = spark.createDataFrame(runs, "id int, status string, code int, out string, err string")
    got = {r.id: r.s for r in df.select("id", rn.failure_signature(*[F.col(c) for c in ("status", "code", "out", "err")]).alias("s")).collect()}
    assert got[0] == got[1] != got[2] and got[3] is None
    body = json.dumps({"status": "FAIL", "return_code": 2, "diagnostic": "other\n"}, sort_keys=True, separators=(",", ":"))
    assert got[2] == hashlib.sha256(body.encode()).hexdigest()
