import pytest
from pyspark.sql import functions as F

from parlance.operators import contracts as C
from parlance.operators.checks import ContractViolation

SCHEMA = {
    "required": ["id", "kind"], "additionalProperties": False,
    "properties": {"id": {"type": "string", "pattern": "^r[0-9]+$"}, "kind": {"enum": ["a", "b"]}, "n": {"type": "integer", "minimum": 1, "maximum": 5}},
    "if": {"properties": {"kind": {"const": "a"}}}, "then": {"required": ["n"]}, "else": {},
}


@pytest.mark.parametrize(
    ("doc", "ok"),
    [('{"id":"r1","kind":"a","n":3}', True), ('{"id":"r1","kind":"b"}', True), ('{"id":"r1","kind":"a"}', False), ('{"id":"x","kind":"b"}', False), ('{"id":"r1","kind":"b","n":true}', False), ('{"id":"r1","kind":"b","n":6}', False), ('{"id":"r1","kind":"b","z":1}', False), ('{"id":"r1","id":"r2","kind":"b"}', False)],
)
def test_schema(spark, doc, ok):
    df = spark.createDataFrame([("1", doc)], "id string, doc string")
    assert C.schema_violations(df, F.col("id"), F.col("doc"), SCHEMA).isEmpty() is ok


def test_comparisons(spark):
    side = "struct<model_label:string,prompt:string,prompt_sha256:string,response:string>"
    kind = f"eval_id string, base {side}, tuned {side}, prompt_equal boolean, do_sample boolean, num_beams int"
    import hashlib

    h = hashlib.sha256(b"p").hexdigest()
    good = ("e", ("m", "p", h, "r"), ("t", "p", h, "r"), True, False, 1)
    assert C.comparison_violations(spark.createDataFrame([good], kind)).isEmpty()
    bad = [("e", ("m", "p", h, " "), ("m", "q", h, "r"), False, True, 1), good]
    assert C.comparison_violations(spark.createDataFrame(bad, kind)).count() == 6


def test_records_and_keys(spark):
    talk = [("user", "u"), ("assistant", "a")]
    kind = "id string, group_id string, split string, kind string, policy string, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([("1", "g", "train", "curated", None, talk), ("2", "g", "test", "imported", "some", talk[:1])], kind)
    assert sorted(r.rule_id for r in C.source_record_violations(df, {"g": "train"}).collect()) == ["V3", "V30", "V30"]
    key = spark.createDataFrame([("J1", "base", "tuned", "0" * 64), ("J1", "base", "base", "x")], "request_id string, a_variant string, b_variant string, core_sha256 string")
    assert C.key_violations(key, 2).count() == 3 and C.key_violations(key.limit(1), 1).isEmpty()


def test_safety_reviews(spark):
    rows = [("r1", 0, "x", "safety", []), ("r1", 1, "y", "daily", []), ("r2", 0, "z", "daily", [" Harm "]), ("r3", 0, "w", "daily", None)]
    df = C.critical_rows(spark.createDataFrame(rows, "record_id string, turn int, response string, capability string, risk_flags array<string>"), ["safety"], ["harm"])
    template = C.safety_template(df, ["calm", "true"])
    assert {r.record_id: len(r.turns) for r in template.collect()} == {"r1": 2, "r2": 1}
    filled = template.withColumn("reviewer", F.lit("p")).withColumn("answers", F.create_map(F.lit("calm"), F.lit("pass"), F.lit("true"), F.when(F.col("record_id") == "r1", "fail").otherwise(" Pass ")))
    assert [tuple(r) for r in C.safety_outcome(filled, template, ["calm", "true"]).collect()] == [("r1", "human", "true")]
    assert {r["class"] for r in C.safety_outcome(template, template, ["calm"]).collect()} == {"integrity"}


def test_audits_and_identities(spark):
    assert C.retry_delays(5) == [1.0, 2.0, 4.0, 8.0] and C.retry_delays(7)[-1] == 8.0
    audit = spark.createDataFrame([("a", 1, "api_error", True), ("a", 2, "ok", False), ("b", 1, "ok", False), ("b", 2, "ok", False), ("c", 2, "ok", False)], "request_id string, attempt int, status string, retryable boolean")
    assert {r.record_id for r in C.audit_violations(audit).collect()} == {"b", "c"}
    identity = dict.fromkeys(C.IDENTITY, 1) | {"bos_token_id": None}
    assert len(C.identity_hash(identity)) == 64
    with pytest.raises(ContractViolation):
        C.identity_hash({k: v for k, v in identity.items() if k != "bos_token_id"})


NESTED = {"properties": {"who": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": "string", "minLength": 2}}}, "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "enum": ["a", "b"]}}, "turns": {"items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}}}


@pytest.mark.parametrize(
    ("doc", "ok"),
    [("{}", True), ('{"who":{"name":"xy"},"tags":["a","b"]}', True), ('{"who":{"name":"x"}}', False), ('{"who":{}}', False), ('{"who":{"name":"xy","z":1}}', False), ('{"tags":[]}', False), ('{"tags":["c"]}', False), ('{"tags":[1]}', False), ('{"tags":"a"}', False), ('{"turns":[{"n":1},{"n":2}]}', True), ('{"turns":[{"n":1},{"n":true}]}', False), ('{"turns":[{}]}', False)],
)
def test_nested_schema(spark, doc, ok):
    df = spark.createDataFrame([("1", doc)], "id string, doc string")
    assert C.schema_violations(df, F.col("id"), F.col("doc"), NESTED).isEmpty() is ok
