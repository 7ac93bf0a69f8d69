"""Canonical JSON of any column: keys in code point order at every depth, no white space, fixed forms of numbers and strings.

The text is what a dump with sorted keys, compact separators and unescaped letters gives elsewhere, so hashes of both are equal:
control characters as \\u00xx in lower case, doubles with an exponent below 1e-4 and from 1e16 on. Nulls are written. Numbers that
are not finite have no JSON; they are null, as is a whole value that is missing. Digits of doubles are the JVM's: before release 19 it
writes one digit too many for a few values (4.9e-324 is one).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_RARE = {chr(k): {8: "\\b", 12: "\\f"}.get(k, f"\\u{k:04x}") for k in range(32) if chr(k) not in _SHORT}


def quoted(text: Column) -> Column:
    """A JSON string. The rare control characters are looked for once before they are replaced one by one."""
    out = text
    for raw, escaped in _SHORT.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for raw, escaped in _RARE.items():
        rare = F.replace(rare, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def real(x: Column) -> Column:
    """A double: digits as the JVM gives them, placed by their exponent."""
    s = F.abs(x).cast("string")
    pattern = r"^([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"
    whole, part = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
    power = F.coalesce(F.nullif(F.regexp_extract(s, pattern, 3), F.lit("")).cast("int"), F.lit(0))
    every = F.concat(whole, part)
    digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
    # the value is 0.digits * 10 ** point
    point = F.length(whole) + power - (F.length(every) - F.length(F.regexp_replace(every, "^0+", "")))
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(F.lit(0), k))
    plain = F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    power10 = point - 1
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    science = F.concat(F.substring(digits, 1, 1), tail, F.when(power10 < 0, "e-").otherwise("e+"), F.lpad(F.abs(power10).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power10).cast("string"))), F.lit("0")))
    sign = F.when((x < 0) | ((x == 0) & s.isNotNull() & x.cast("string").startswith("-")), "-").otherwise("")
    body = F.when(n == 0, "0.0").when((power10 >= -4) & (power10 < 16), plain).otherwise(science)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.concat(sign, body))


def canonical(c: Column, kind: T.DataType) -> Column:
    """JSON text of a column of a known type; null for null."""
    inner = lambda x, t: F.coalesce(canonical(x, t), F.lit("null"))
    if isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            parts += [F.lit(("," if parts else "") + json.dumps(f.name, ensure_ascii=False) + ":"), inner(c.getField(f.name), f.dataType)]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: inner(x, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of a JSON object are strings")
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(quoted(k), F.lit(":"), inner(F.try_element_at(c, k), kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    if isinstance(kind, T.StringType):
        return quoted(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return real(c.cast("double"))
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        return c.cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return quoted(c.cast("string"))
    raise TypeError(f"{kind.simpleString()} has no canonical JSON")


def canonical_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row's columns as one canonical object."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return canonical(F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in fields]), T.StructType(fields))
