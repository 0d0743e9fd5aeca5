"""What a formula in prose says: variables, entrypoints, trigger, precondition, relation, observation, contracts.

Patterns are fixed values. A null formula counts as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*\(([^)]*)\)"
ENTRY = r"`([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)`|\b([A-Za-z_]\w*\.[A-Za-z_]\w*)\b"
PRECONDITION = r"(?i)\b(?:if|when|unless|provided that)\s+(.+?)(?:,|\bthen\b)"
CONJUNCTION = r"(?i)\s+(?:and|but also|as well as)\s+|\s*;\s*"
QUANTIFIED = r"(?i)\b(?:for all|every|any)\s+([A-Za-z_]\w*)"
NOT_NAMES = ["none", "true", "false", "int", "str", "list", "dict"]
OPERATIONS = ["iterate", "compare", "add", "index", "contain", "enter", "exit", "call"]
#: Kind, then words of the lower-case text (the last also symbols of the text itself); first match wins.
RELATIONS = [("exception", ["raise", "exception", "error"]), ("preservation", ["unchanged", "preserve", "same as"]), ("temporal", ["before", "after", "order", "eventually"]), ("metamorphic", ["idempotent", "twice", "repeat"])]
EQUALITY = ["==", "equal", "return", "yield"]
CHANNELS = [("return", ["return", "yield", "result", "equal"]), ("exception", ["raise", "exception", "error"]), ("state", ["state", "mutate", "unchanged", "field"]), ("output", ["stdout", "stderr", "print", "output"]), ("calls", ["call", "dispatch", "protocol"]), ("effects", ["file", "network", "database", "side effect"])]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def decompose(formula: Column) -> Column:
    """The parts that conjunctions join, trimmed; the formula itself if nothing is left."""
    parts = F.filter(F.transform(F.split(formula, CONJUNCTION), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(formula)))


def variable_names(formula: Column, concrete: Column) -> Column:
    """Names in the arguments of calls, and quantified ones; sorted. Concrete formulas have none."""
    words = F.flatten(F.transform(_all(formula, CALL, 2), lambda a: F.regexp_extract_all(a, F.lit(r"\b[A-Za-z_]\w*\b"), F.lit(0))))
    names = F.filter(words, lambda w: ~F.lower(w).isin(NOT_NAMES))
    found = F.array_sort(F.array_distinct(F.concat(names, _all(formula, QUANTIFIED, 1))))
    return F.when(F.coalesce(concrete, F.lit(False)), F.array().cast("array<string>")).otherwise(found)


def entrypoints(formula: Column) -> Column:
    """Back-ticked and dotted names and called ones, without those that another one goes on from; sorted."""
    names = F.array_distinct(F.filter(F.concat(_all(formula, ENTRY, 1), _all(formula, ENTRY, 2), _all(formula, CALL, 1)), lambda x: x != ""))
    return F.array_sort(F.filter(names, lambda a: ~F.exists(names, lambda b: F.startswith(b, F.concat(a, F.lit("."))))))


def trigger(formula: Column) -> Column:
    call, out = F.regexp_extract(formula, CALL, 0), F
    out = out.when(call != "", call)
    for op in OPERATIONS:
        out = out.when(F.contains(F.lower(formula), F.lit(op)), op)
    return out.otherwise("public_invocation")


def relation_kind(formula: Column) -> Column:
    low, out = F.lower(formula), F
    for kind, words in RELATIONS:
        out = out.when(_any(low, words), kind)
    return out.when(_any(formula, EQUALITY), "equality").otherwise("trace_predicate")


def relation_arity(kind: Column) -> Column:
    return F.when(kind.isin("preservation", "metamorphic"), 2).otherwise(1)


def channels(formula: Column) -> Column:
    """Where a formula is observed; sorted, `return` if it doesn't say."""
    low = F.lower(formula)
    found = F.array_compact(F.array(*[F.when(_any(low, words), name) for name, words in CHANNELS]))
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("return")))


def contracts(formula: Column, kind: Column) -> Column:
    """struct(exception, state, preservation) of a formula whose relation is of this kind."""
    low = F.lower(formula)
    thrown = F.nullif(F.regexp_extract(formula, r"\b([A-Z][A-Za-z]+(?:Error|Exception))\b", 1), F.lit(""))
    exception = F.struct((kind == "exception").alias("required"), thrown.alias("type"), F.when(F.contains(low, F.lit("message")), "declared").alias("message_category"), F.lit("stimulus").alias("phase"))
    state = F.struct((F.contains(low, F.lit("state")) & ~F.contains(low, F.lit("unchanged"))).alias("must_change"), _any(low, ["unchanged", "must not mutate", "preserve state"]).alias("must_preserve"), F.array_sort(F.array_distinct(_all(formula, r"\bself\.([A-Za-z_]\w*)", 1))).alias("fields"))
    keeps = kind == "preservation"
    preservation = F.struct((keeps | _any(low, ["preserve", "unchanged", "still pass", "must not break"])).alias("required"), F.when(keeps, formula).otherwise("baseline public behavior").alias("formula"))
    return F.struct(exception.alias("exception"), state.alias("state"), preservation.alias("preservation"))


def precondition_text(formula: Column) -> Column:
    """What stands after if, when, unless or provided that, up to a comma or `then`; null if there is none. Whether it
    is an expression, the constraint language decides (see constraints)."""
    return F.nullif(F.trim(F.regexp_extract(formula, PRECONDITION, 1)), F.lit(""))


def none_precondition(formula: Column, variables: Column) -> Column:
    """`x is None` or `x is not None` of the first variable that the text says it of; else True."""
    low = F.lower(formula)
    said = lambda v, tail: F.contains(low, F.concat(v, F.lit(tail)))
    hits = F.filter(variables, lambda v: said(v, " is none") | said(v, " is not none"))
    first = F.get(hits, 0)
    return F.when(F.size(hits) == 0, "True").when(said(first, " is none"), F.concat(first, F.lit(" is None"))).otherwise(F.concat(first, F.lit(" is not None")))
