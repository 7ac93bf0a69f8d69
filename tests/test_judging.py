"""Requests and keys, audits of calls, and a stream of judgments that dies and goes on."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from parlance.operators import audit as A
from parlance.operators import requests as Q
from parlance.operators.checks import ContractViolation
from parlance.streaming.resume import AUDIT, RESULTS, run_pending, stored

TEMPLATE = {"z": ["x", "y"], "case": {"b": Q.Field("response_b"), "a": Q.Field("response_a"), "who": Q.Field("latest_user_message")}}
IDENTITY = {"judge": {"model": "m", "seed": 1}}


def sides(spark, gold="the golden answer"):
    side = "struct<model_label: string, context: string, response: string, rules: map<string, double>>"
    schema = f"eval_id string, record_id string, split string, capability string, scenario_group string, mode string, assistant_turn_index int, seriousness int, risk_flags array<string>, latest_user_message string, gold_response string, base {side}, tuned {side}"
    row = lambda i, b, t: (i, "r", "test", "c", "g", "m", 1, 1, [], 'say "x"\n', gold, ("model-b", "cb", b, {"k": 1.0}), ("model-t", "ct", t, {"k": 2.5}))
    c = spark.createDataFrame([row("1", "answer b1", "answer t1"), row("2", "answer b2", "it is the golden answer")], schema)
    return c, spark.createDataFrame([("R1", "1", False), ("R2", "2", True)], "review_id string, eval_id string, swapped boolean")


def test_requests_equal_a_plain_build(spark):
    dump = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    requests, key = Q.build(*sides(spark), "system", TEMPLATE, IDENTITY)
    got, keys = {r.request_id: r for r in requests.collect()}, {r.request_id: r for r in key.collect()}
    for name, a, b in (("J1", ("base", "model-b", "cb", "answer b1", 1.0), ("tuned", "model-t", "ct", "answer t1", 2.5)), ("J2", ("tuned", "model-t", "ct", "it is the golden answer", 2.5), ("base", "model-b", "cb", "answer b2", 1.0))):
        payload = {"z": ["x", "y"], "case": {"a": a[3], "b": b[3], "who": 'say "x"\n'}}
        messages = [{"role": "system", "content": "system"}, {"role": "user", "content": dump(payload)}]
        core = {"request_id": name, "identity": IDENTITY, "prompt_sha256": sha(dump(messages)), "messages": messages}
        assert [m.asDict() for m in got[name].messages] == messages and got[name].judgment is None
        assert (keys[name].prompt_sha256, keys[name].request_sha256) == (core["prompt_sha256"], sha(dump(core)))
        for side, want in ((keys[name].a, a), (keys[name].b, b)):
            assert (side.variant, side.model_label, side.context_sha256, side.response_sha256, side.rules) == (want[0], want[1], sha(want[2]), sha(want[3]), {"k": want[4]})
    assert len(Q.template_hash(TEMPLATE)) == 64 and Q.template_hash(TEMPLATE) != Q.template_hash(TEMPLATE | {"z": []})


def test_what_a_judge_must_not_see(spark):
    for name in ("gold_response", "swapped", "base", "model_label", "request_id"):
        with pytest.raises(ValueError, match="must not show"):
            Q.compiled({"case": [Q.Field(name)]})
    c, a = sides(spark)
    requests, _ = Q.build(c, a, "system", TEMPLATE, IDENTITY)
    assert Q.leaks(requests, c, a).isEmpty()  # an answer that is the gold answer is no leak
    shown = lambda text: requests.withColumn("messages", F.transform("messages", lambda m: m.withField("content", F.concat(m["content"], F.lit(text)))))
    assert {(r.record_id, r.detail) for r in Q.leaks(shown(" the golden answer, by model-t"), c, a).collect()} == {("J1", "gold answer"), ("J1", "model name"), ("J2", "model name")}
    c, a = sides(spark, 'a "quoted"\ngold')
    requests, _ = Q.build(c, a, "system", TEMPLATE | {"case": TEMPLATE["case"] | {"gold": 'a "quoted"\ngold'}}, IDENTITY)
    assert Q.leaks(requests, c, a).count() == 2


def test_altered_requests_keys_and_sheets(spark):
    c, a = sides(spark)
    made = Q.build(c, a, "system", TEMPLATE, IDENTITY)
    judged = made[0].withColumn("judgment", F.lit("{}"))
    assert Q.altered(judged, made[1], made).isEmpty()
    other = made[1].withColumn("a", F.when(F.col("request_id") == "J1", F.col("a").withField("rules", F.create_map(F.lit("k"), F.lit(9.0)))).otherwise(F.col("a")))
    got = Q.altered(judged.unionByName(judged.limit(1)).withColumn("identity", F.col("identity").withField("judge.seed", F.lit(2))), other.where("request_id = 'J1'"), made).collect()
    assert {(r.rule_id, r.record_id, r.detail) for r in got} >= {("V19", "J1", "identity"), ("V19", "J2", "identity"), ("D4", "J1", "a"), ("D4", "J2", "missing")} and sum(r.detail == "repeated" for r in got) == 1
    sheet = Q.blind(c, a).select("request_id", "context_a", "response_a", "context_b", "response_b")
    assert Q.review_tampering(sheet, made[1]).isEmpty()
    assert [(r.record_id, r.detail) for r in Q.review_tampering(sheet.withColumn("response_b", F.when(F.col("request_id") == "J2", "x").otherwise(F.col("response_b"))), made[1]).collect()] == [("J2", "response_b")]


def test_audit_of_calls(spark):
    schema = "run int, seq int, request_id string, request_sha256 string, prompt_sha256 string, attempt int, status string, retryable boolean, judgment_sha256 string, response_model string, system_fingerprint string"
    ok = lambda run, seq, i, attempt=1, j="a" * 64, model="m", fp="f": (run, seq, i, "q", "p", attempt, "ok", False, j, model, fp)
    bad = lambda run, seq, i, attempt, again: (run, seq, i, "q", "p", attempt, "api_error", again, None, None, None)
    key = spark.createDataFrame([(i, "q") for i in "abcd"], "request_id string, request_sha256 string")
    calls = spark.createDataFrame([ok(1, 0, "a"), bad(1, 1, "b", 1, True), ok(1, 2, "b", 2), bad(1, 3, "c", 1, False), ok(2, 0, "c"), ok(2, 1, "d")], schema)
    results = spark.createDataFrame([(i, "p", "a" * 64) for i in "abcd"], "request_id string, prompt_sha256 string, judgment_sha256 string")
    assert A.call_violations(calls, "m").isEmpty() and A.result_violations(results, calls, key, "m").isEmpty()
    s = A.audit_summary(results, calls).first()
    assert (s.calls, s.runs, s.successes, s.results, s.system_fingerprint) == (6, 2, 4, 4, "f")
    drift = calls.unionByName(spark.createDataFrame([ok(3, 0, "a", fp="g")], schema))
    assert [r.detail for r in A.call_violations(drift, "m").collect()] == ["2 fingerprints"] and A.audit_summary(results, drift).first().system_fingerprint is None
    empty = calls.limit(0)
    assert {r.detail for r in A.result_violations(results, empty, key, "m").collect()} == {"no successful call"} and A.call_violations(empty, "m").isEmpty()


def test_a_stream_that_dies_between_audit_and_results(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("requests", "results", "audit", "checkpoint")}
    (tmp_path / "requests").mkdir()
    put = lambda name, ids: (tmp_path / "requests" / name).write_text("".join(json.dumps({"request_id": i, "q": "x"}) + "\n" for i in ids))
    judge = lambda df: df.select("request_id", F.when(F.col("request_id") == "bad", "api_error").otherwise("ok").alias("status"), F.concat(F.uuid(), F.lit("-"), "request_id").alias("judgment"), F.lit("f").alias("fingerprint"))
    died = []

    def die_once(n):
        if not died:
            died.append(n)
            raise RuntimeError("killed")

    def run(**more):
        run_pending(spark, paths["requests"], "request_id string, q string", paths["results"], paths["audit"], paths["checkpoint"], judge, **more).awaitTermination()

    def held():
        return stored(spark, paths["results"], RESULTS).collect(), stored(spark, paths["audit"], AUDIT).collect()

    put("1.json", ["a", "b", "b", "bad"])
    with pytest.raises(Exception, match="killed"):
        run(audited=die_once)
    results, calls = held()
    assert not results and len(calls) == 3 and {c["try"] for c in calls} == {0}
    run(audited=die_once)
    results, calls = held()
    assert sorted(r.request_id for r in results) == ["a", "b"] and sorted((c.request_id, c["try"]) for c in calls) == sorted((i, t) for i in ("a", "b", "bad") for t in (0, 1))
    # each result is the one that its own try was answered with
    assert {(r.request_id, r.judgment) for r in results} == {(c.request_id, c.judgment) for c in calls if c["try"] == 1 and c.status == "ok"}
    put("2.json", ["b", "c"])
    run()
    run()
    results, calls = held()
    assert sorted(r.request_id for r in results) == ["a", "b", "c"] and len(calls) == 7
    # a result that was changed by hand stops the next run before anything is judged
    spark.createDataFrame([("d", "made up", "0")], "request_id string, judgment string, judgment_sha256 string").write.parquet(f"{paths['results']}/batch=99")
    with pytest.raises(ContractViolation, match="D17 d: no successful call"):
        run()
