"""JSON schemas compiled to column expressions, and their violations by path and keyword.

A schema (draft 7) becomes one test for each keyword at each place; a document is parsed once and all tests run in one pass. As in
the draft, a keyword speaks of its own kind of value only (a pattern of strings, a minimum of numbers), 1.0 is an integer, and 1 and 1.0 are equal
numbers, which true is not. In arrays and objects that are compared as wholes, 1 and 1.0 differ. A keyword that is not known here ends the
compilation: nothing is passed over in silence. Annotations are allowed and say nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = Callable[[Column], Column]
ANNOTATIONS = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _at(v: Column, name: str) -> Column:
    if "'" in name and '"' in name:
        raise ValueError(f"{name!r} can't be the name of a property here")
    return F.try_variant_get(v, f"$['{name}']" if "'" not in name else f'$["{name}"]', "variant")


KINDS: dict[str, Test] = {
    "string": lambda v: _kind(v) == "STRING",
    "boolean": lambda v: _kind(v) == "BOOLEAN",
    "null": lambda v: _kind(v) == "VOID",
    "array": lambda v: _kind(v).startswith("ARRAY"),
    "object": lambda v: _kind(v).startswith("OBJECT"),
    "number": lambda v: (_kind(v) == "BIGINT") | (_kind(v) == "DOUBLE") | _kind(v).startswith("DECIMAL"),
    "integer": lambda v: (_kind(v) == "BIGINT") | ((_kind(v) == "DOUBLE") | _kind(v).startswith("DECIMAL")) & (_number(v) % 1 == 0),
}


def _plain(v: Column) -> Column:
    """A text that equal values share."""
    return F.when(KINDS["number"](v), F.concat(F.lit("n"), (_number(v) + 0.0).cast("string"))).otherwise(F.concat(F.lit("j"), F.to_json(v)))


def _equals(v: Column, value) -> Column:
    return F.coalesce(_plain(v) == _plain(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False)))), F.lit(False))


def _every(tests: list[Test], v: Column) -> Column:
    return reduce(and_, [t(v) for t in tests], F.lit(True))


def _whole(schema) -> Test:
    """One test for all that a schema asks."""
    tests = [t for _, _, t in compiled(schema)]
    return lambda v: _every(tests, v)


def _of(kind: str, test: Test) -> Test:
    """A test of values of one kind; others pass."""
    return lambda v: ~KINDS[kind](v) | F.coalesce(test(v), F.lit(False))


#: keyword -> test, from the keyword's argument; for keywords that need nothing else of their schema.
SIMPLE: dict[str, Callable[[object], Test]] = {
    "type": lambda x: lambda v: reduce(lambda a, b: a | b, [KINDS[k](v) for k in ([x] if isinstance(x, str) else x)]),
    "enum": lambda x: lambda v: reduce(lambda a, b: a | b, [_equals(v, e) for e in x], F.lit(False)),
    "const": lambda x: lambda v: _equals(v, x),
    "pattern": lambda x: _of("string", lambda v: F.rlike(_text(v), F.lit(x))),
    "minLength": lambda x: _of("string", lambda v: F.length(_text(v)) >= x),
    "maxLength": lambda x: _of("string", lambda v: F.length(_text(v)) <= x),
    "minimum": lambda x: _of("number", lambda v: _number(v) >= x),
    "maximum": lambda x: _of("number", lambda v: _number(v) <= x),
    "exclusiveMinimum": lambda x: _of("number", lambda v: _number(v) > x),
    "exclusiveMaximum": lambda x: _of("number", lambda v: _number(v) < x),
    "minItems": lambda x: _of("array", lambda v: F.size(_items(v)) >= x),
    "maxItems": lambda x: _of("array", lambda v: F.size(_items(v)) <= x),
    "uniqueItems": lambda x: _of("array", lambda v: F.size(F.array_distinct(F.transform(_items(v), _plain))) == F.size(_items(v))) if x else lambda v: F.lit(True),
    "allOf": lambda x: lambda v: _every([_whole(s) for s in x], v),
    "anyOf": lambda x: lambda v: reduce(lambda a, b: a | b, [_whole(s)(v) for s in x]),
    "oneOf": lambda x: lambda v: reduce(lambda a, b: a + b, [_whole(s)(v).cast("int") for s in x]) == 1,
    "not": lambda x: lambda v: ~_whole(x)(v),
}
NESTED = {"properties", "required", "additionalProperties", "items", "if", "then", "else"}


def refuse_unknown(schema, path: str = "$") -> None:
    """Raises for a keyword, or a kind of value, that has no test here."""
    if isinstance(schema, bool):
        return
    if unknown := sorted(set(schema) - set(SIMPLE) - NESTED - ANNOTATIONS):
        raise ValueError(f"{path}: unknown keyword {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if bad := [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in KINDS]:
        raise ValueError(f"{path}: unknown type {', '.join(map(str, bad))}")
    for word in ("additionalProperties", "items", "if", "then", "else", "not"):
        if isinstance(schema.get(word), list):
            raise ValueError(f"{path}: a list of {word} is not supported")
        if word in schema:
            refuse_unknown(schema[word], f"{path}.{word}")
    for name, sub in schema.get("properties", {}).items():
        refuse_unknown(sub, f"{path}.{name}")
    for word in ("allOf", "anyOf", "oneOf"):
        for i, sub in enumerate(schema.get(word, ())):
            refuse_unknown(sub, f"{path}.{word}[{i}]")


def compiled(schema, path: str = "$") -> Iterator[tuple[str, str, Test]]:
    """(path, keyword, test) for everything that a schema asks; items of arrays share a path."""
    if isinstance(schema, bool):
        yield path, "false", lambda v: F.lit(schema)
        return
    for word, argument in schema.items():
        if word in SIMPLE:
            yield path, word, SIMPLE[word](argument)
    for name in schema.get("required", ()):
        yield f"{path}.{name}", "required", _of("object", lambda v, n=name: _at(v, n).isNotNull())
    for name, sub in schema.get("properties", {}).items():
        for place, word, test in compiled(sub, f"{path}.{name}"):
            yield place, word, lambda v, n=name, t=test: _at(v, n).isNull() | t(_at(v, n))  # a JSON null is a value, and not null here
    if "additionalProperties" in schema:
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        inner = _whole(schema["additionalProperties"])
        others = lambda v: F.map_values(F.map_filter(F.try_variant_get(v, "$", "map<string, variant>"), lambda k, _: ~F.array_contains(known, k)))
        yield path, "additionalProperties", _of("object", lambda v: F.forall(others(v), inner))
    if "items" in schema:
        for place, word, test in compiled(schema["items"], f"{path}[]"):
            yield place, word, _of("array", lambda v, t=test: F.forall(_items(v), lambda e: t(e)))
    if "if" in schema:
        when, then, other = (_whole(schema.get(w, True)) for w in ("if", "then", "else"))
        yield path, "if", lambda v: F.when(when(v), then(v)).otherwise(other(v))


def schema_violations(df: DataFrame, record: Column, doc: Column, schema: dict, rule: str = "V2") -> DataFrame:
    """(rule_id, record_id, detail): each path and keyword that a JSON document breaks; texts that are not strict JSON break them all at once."""
    refuse_unknown(schema)
    x = df.select(record.cast("string").alias("record_id"), F.try_parse_json(doc).alias("v"))
    v = F.col("v")
    tests = [F.when(v.isNull(), F.lit("not strict JSON"))]
    tests += [F.when(v.isNotNull() & ~test(v), F.lit(f"{path}: {word}")) for path, word, test in compiled(schema)]
    found = F.explode(F.array_distinct(F.array_compact(F.array(*tests))))
    return x.select(F.lit(rule).alias("rule_id"), "record_id", found.alias("detail"))
