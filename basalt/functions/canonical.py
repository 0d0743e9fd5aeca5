"""Canonical JSON of typed columns, content hashes and stable ids.

Objects have sorted keys, no blanks stand between tokens, what isn't ASCII is escaped as UTF-16 units, and floats have
their shortest form as Python writes it. Maps need text keys. A null column is null in JSON, and not SQL's null. Sets
are arrays that `as_set` sorts by their items' JSON. NaN and infinities have no JSON: they give SQL's null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters with an escape of their own.
ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def quoted(text: Column) -> Column:
    """A JSON string; texts of plain ASCII aren't taken apart."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))

    def escape(unit: Column) -> Column:
        out = F
        for k, v in ESCAPES.items():
            out = out.when(unit == f"{k:04X}", v)
        plain = F.decode(F.unhex(F.substring(unit, 3, 2)), "US-ASCII")
        return out.when((unit >= "0020") & (unit < "007F"), plain).otherwise(F.concat(F.lit("\\u"), F.lower(unit)))

    each = F.array_join(F.transform(units, escape), "")
    body = F.when(text.rlike('^[ !#-\\[\\]-\\x7e]*\\z'), text).otherwise(each)
    return F.concat(F.lit('"'), body, F.lit('"'))


def number(x: Column) -> Column:
    """A double as Python's repr: plain from 1e-4 up to below 1e16, else with an exponent of two digits at least."""
    text = F.abs(x).cast("string")
    parts = F.split(text, "E")
    mantissa = parts[0]
    exponent = F.coalesce(F.get(parts, 1).cast("int"), F.lit(0)) + F.length(F.substring_index(mantissa, ".", 1)) - 1  # of the first digit
    raw = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "^0+(?=.)", "")
    lead = F.length(F.replace(mantissa, F.lit("."), F.lit(""))) - F.length(raw)  # zeros before the first digit of 0.00x
    digits = F.regexp_replace(raw, "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    e = exponent - lead
    n = F.length(digits)
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, "0"), F.lit("."), F.when(n > e + 1, F.substring(digits, e + 2, n)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    tail = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
    far = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), tail)
    body = F.when(F.abs(x) == 0, "0.0").when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small).otherwise(far)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("string")).otherwise(F.concat(sign, body))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON text of a column of this type."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat(*[x for p in parts for x in (F.lit(","), p)][1:]), F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        pair = lambda x: F.concat(quoted(x["key"]), F.lit(":"), canonical_json(x["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def as_set(items: Column, kind: T.DataType) -> Column:
    """JSON of an array that stands for a set: items in the order of their own JSON."""
    return F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(items, lambda x: canonical_json(x, kind))), ","), F.lit("]"))


def content_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def clean_prefix(prefix: Column) -> Column:
    """Letters and digits of any script, - and _ stay; all else becomes -."""
    return F.regexp_replace(prefix, "[^\\p{L}\\p{N}_-]", "-")


def stable_id(prefix: Column, *parts: Column, length: int = 24) -> Column:
    """parts: JSON texts of the arguments."""
    body = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.concat(clean_prefix(prefix), F.lit("-"), F.substring(content_hash(body), 1, length))
