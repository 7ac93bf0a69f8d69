"""JSON values taken apart, and every keyword of a schema both ways."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import schema as S
from parlance.operators import values as V


def test_parts():
    assert V.parts('{"b":[1,1.0,true,"1",null,{}],"a":[]}') and V.parts(None) == [("$", "missing", "")]
    assert sorted(V.parts('{"b":[1,1.0,true,"1",null,{}],"a":[]}')) == sorted([("$", "object", ""), ('$["b"]', "array", ""), ('$["b"][0]', "integer", "1"), ('$["b"][1]', "number", "1.0"), ('$["b"][2]', "boolean", "true"), ('$["b"][3]', "string", "1"), ('$["b"][4]', "null", ""), ('$["b"][5]', "object", ""), ('$["a"]', "array", "")])
    for bad in ('{"a":1,"a":1}', "NaN", "[Infinity]", "1 2", "", "{", "[" * 100_000):
        assert V.parts(bad) == [("$", "invalid", bad)]
    assert V.parts("123456789012345678901234567890") == [("$", "integer", "123456789012345678901234567890")]


def exact(a, b):
    """Equal values of equal types."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(exact(a[k], b[k]) for k in a)
    return len(a) == len(b) and all(map(exact, a, b)) if isinstance(a, list) else a == b


def test_differences_are_those_of_typed_equality(spark):
    rng = random.Random(4)
    leaf = [1, 1.0, True, False, 0, "1", "", None, [], {}, 2, "x.y"]

    def value(depth):
        k = rng.randrange(4) if depth else 0
        return [value(depth - 1) for _ in range(rng.randrange(4))] if k == 1 else {rng.choice("ab\"'. "): value(depth - 1) for _ in range(rng.randrange(4))} if k == 2 else rng.choice(leaf)

    pairs = [(value(2), value(2)) for _ in range(250)] + list(itertools.product(leaf, leaf))
    dump = lambda v: json.dumps(dict(reversed(v.items())) if isinstance(v, dict) else v, indent=rng.choice([None, 1]))
    left = spark.createDataFrame([(i, dump(a), "z") for i, (a, _) in enumerate(pairs)] + [(None, "1", "z"), (9999, "1", "z")], "id int, doc string, path string").repartition(3)
    right = spark.createDataFrame([(i, dump(b), "z") for i, (_, b) in enumerate(pairs)] + [(None, "2", "z"), (8888, None, "z")], "id int, doc string, path string")
    got = V.differences(left, right, "id", "doc").collect()
    assert {r.id for r in got} == {i for i, (a, b) in enumerate(pairs) if not exact(a, b)} | {None, 9999}
    assert [(r.left_type, r.right_type) for r in got if r.id == 9999] == [("integer", "missing")]
    assert V.differences(left, left, "id", "doc").isEmpty() and V.differences(left.limit(0), right.limit(0), "id", "doc").isEmpty()


CASES = [
    ({"type": "string"}, ['"a"'], ["1", "null", "[]"]),
    ({"type": ["integer", "null"]}, ["1", "1.0", "null", "-3", "12345678901234567890"], ["1.5", "true", '"1"']),
    ({"type": "number"}, ["1", "1.5", "1e3"], ["true", '"1"']),
    ({"type": "object"}, ["{}"], ["[]"]),
    ({"type": "array"}, ["[]", "[1]"], ["{}"]),
    ({"type": "boolean"}, ["true"], ["0"]),
    ({"enum": ["a", 1, None, [1], True]}, ['"a"', "1", "1.0", "null", "[1]", "true"], ['"b"', "2", "false", "[2]", '"1"']),
    ({"const": False}, ["false"], ["0", "true", "null"]),
    ({"const": {"a": 1, "b": "x"}}, ['{"b":"x","a":1}'], ['{"a":1}']),
    ({"pattern": "^a[0-9]$"}, ['"a1"', "1", "null"], ['"b1"', '"a12"', '""']),
    ({"minLength": 2, "maxLength": 3}, ['"é😀"', '"abc"', "1"], ['"a"', '"abcd"']),
    ({"minimum": 1, "maximum": 5}, ["1", "5", "2.5", '"x"'], ["0", "5.1", "-1e9"]),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 2}, ["1.5", "null"], ["1", "2"]),
    ({"minItems": 1, "maxItems": 2}, ["[1]", "[1,2]", "{}"], ["[]", "[1,2,3]"]),
    ({"uniqueItems": True}, ["[]", '[1,"1",true,[1],[2]]', '"aa"'], ["[1,1]", "[1,1.0]", '["a","b","a"]', "[[1],[1]]", '[{"a":1,"b":2},{"b":2,"a":1}]']),
    ({"uniqueItems": False}, ["[1,1]"], []),
    ({"items": {"type": "string", "minLength": 1}}, ["[]", '["a"]', "1"], ['["a",""]', "[1]"]),
    ({"required": ["a", "b'c"], "properties": {"b'c": {"type": "integer"}}}, ['{"a":null,"b\'c":1}', "[]"], ['{"a":1}', '{"a":1,"b\'c":"x"}', "{}"]),
    ({"properties": {"a": {"properties": {"b": {"enum": [1]}}}}, "additionalProperties": False}, ['{"a":{"b":1}}', '{"a":1}', "{}"], ['{"a":{"b":2}}', '{"z":1}']),
    ({"properties": {"a": True}, "additionalProperties": {"type": "string"}}, ['{"a":1,"z":"x"}'], ['{"z":1}']),
    ({"properties": {"a": False}}, ["{}"], ['{"a":1}']),
    ({"anyOf": [{"type": "string", "pattern": "^x"}, {"type": "string", "pattern": "y$"}]}, ['"xa"', '"ay"'], ['"a"', "1"]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 2}]}, ["0", "3"], ["1", '"both"']),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}, {"if": {"const": 2}, "then": False}]}, ["1"], ["0", "3", "2"]),
    ({"not": {"required": ["a"]}}, ['{"b":1}'], ['{"a":1}', "[]"]),
    ({"if": {"properties": {"k": {"const": "a"}}, "required": ["k"]}, "then": {"required": ["n"]}, "else": {"not": {"required": ["n"]}}}, ['{"k":"a","n":1}', '{"k":"b"}', "{}"], ['{"k":"a"}', '{"n":1}']),
    ({"$schema": "x", "title": "t", "description": "d"}, ["1"], []),
]


def test_every_keyword_both_ways(spark):
    for schema, good, bad in CASES:
        df = spark.createDataFrame([(d, d) for d in good + bad], "id string, v string")
        found = {r.record_id for r in S.schema_violations(df, F.col("id"), F.col("v"), schema).collect()}
        assert found == set(bad), schema


def test_paths_and_refusals(spark):
    schema = {"type": "object", "required": ["m"], "properties": {"m": {"type": "array", "items": {"required": ["role"], "properties": {"role": {"enum": ["a", "b"]}}}}}}
    docs = ['{"m":[{"role":"a"},{"role":"c"},{}]}', "{}", "[]", '{"m":1}', '{"m":1,"m":2}', None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = sorted((int(r.record_id), r.detail) for r in S.schema_violations(df, F.col("id"), F.col("doc"), schema).collect())
    assert got == [(0, "$.m[].role: enum"), (0, "$.m[].role: required"), (1, "$.m: required"), (2, "$: type"), (3, "$.m: type"), (4, "not strict JSON"), (5, "not strict JSON")]
    for wrong in ({"format": "date"}, {"properties": {"a": {"anyOf": [{"contains": 1}]}}}, {"items": [{}]}, {"type": "text"}, {"not": {"if": {"dependencies": {}}}}):
        with pytest.raises(ValueError, match="unknown|not supported"):
            S.schema_violations(df, F.col("id"), F.col("doc"), wrong)
