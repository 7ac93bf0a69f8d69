"""Queries on judging from end to end: requests and their key, what was altered or leaks, the audit of calls, and the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import audit as A
from ..operators import judge as J
from ..operators import requests as Q
from ..operators.requests import Field
from ..sources.scratch import settled
from ..sources.tables import table
from . import records, texts
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


SYSTEM = "Score both answers from 1 to 5."
IDENTITY = {"judge": {"model": "judge-x", "revision": "r1", "seed": 7, "temperature": 0}, "schema": "v1"}
TEMPLATE = {
    "task": "how close is each answer to the character", "dimensions": list(J.DIMENSIONS),
    "case": {"capability": Field("capability"), "risk_flags": Field("risk_flags"), "latest_user_message": Field("latest_user_message"), "candidate_a": {"context": Field("context_a"), "response": Field("response_a")}, "candidate_b": {"context": Field("context_b"), "response": Field("response_b")}},
}


def comparisons(spark, d):
    """Two answers to each labelled document, with their rule metrics."""
    i = F.col("doc_id").cast("string")
    own = texts.responses(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id").withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("tuned"))))
    own = own.withColumn("text", F.when(F.col("variant") == "base", F.col("text")).otherwise(F.concat("text", F.lit(records.TAIL))))
    own = texts.measured(own, texts.METRICS)
    rules = F.create_map(*[x for m in texts.METRICS for x in (F.lit(m), F.col(m).cast("double"))])
    side = F.struct(F.concat(F.lit("model-"), "variant").alias("model_label"), F.concat(F.lit("context of "), i).alias("context"), F.col("text").alias("response"), rules.alias("rules"))
    own = own.select("doc_id", "variant", "capability", side.alias("side"))
    at = lambda v: F.first(F.when(F.col("variant") == v, F.col("side")), ignorenulls=True).alias(v)
    x = own.groupBy("doc_id", "capability").agg(at("base"), at("tuned"))
    # written once: metrics of whole texts are dear, and a key, its rebuilding and the checks of leaks all start here
    return settled(x.select(
        i.alias("eval_id"), i.alias("record_id"), F.lit("test").alias("split"), "capability", F.concat(F.lit("g"), F.floor(F.col("doc_id") / 3).cast("string")).alias("scenario_group"), F.lit("rollout").alias("mode"), F.lit(1).alias("assistant_turn_index"),
        (F.pmod("doc_id", F.lit(5)) + 1).alias("seriousness"), F.when(F.pmod("doc_id", F.lit(6)) == 0, F.array(F.lit("harm"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"), F.concat(F.lit("say \""), i, F.lit("\"")).alias("latest_user_message"), F.concat(F.lit("golden answer "), i).alias("gold_response"), "base", "tuned",
    ))


def assignment(spark, d):
    i = F.col("doc_id").cast("string")
    return table(spark, d, "labels").select(F.concat(F.lit("R"), i).alias("review_id"), i.alias("eval_id"), (F.substring(F.sha2(i, 256), 1, 1) < "8").alias("swapped"))


def built(spark, d):
    return Q.build(comparisons(spark, d), assignment(spark, d), SYSTEM, TEMPLATE, IDENTITY)


_LIST = "[" + ", ".join(map(S.q, J.DIMENSIONS)) + "]"
_SIDES = f"""s AS (SELECT r.doc_id, r.doc_id::varchar AS i, r.capability, sha256(r.doc_id::varchar)[1:1] < '8' AS swapped, r.text AS base, r.text || {S.q(records.TAIL)} AS tuned FROM labels l JOIN {texts.RESPONSES} r ON l.doc_id = r.doc_id),
  q AS (SELECT *, 'context of ' || i AS context, CASE WHEN swapped THEN tuned ELSE base END AS ra, CASE WHEN swapped THEN base ELSE tuned END AS rb FROM s),
  p AS (SELECT *, to_json({{'case': {{'candidate_a': {{'context': context, 'response': ra}}, 'candidate_b': {{'context': context, 'response': rb}}, 'capability': capability, 'latest_user_message': 'say "' || i || '"', 'risk_flags': CASE WHEN doc_id % 6 = 0 THEN ['harm'] ELSE []::varchar[] END}}, 'dimensions': {_LIST}, 'task': {S.q(TEMPLATE['task'])}}})::varchar AS payload FROM q),
  m AS (SELECT *, [{{'content': {S.q(SYSTEM)}, 'role': 'system'}}, {{'content': payload, 'role': 'user'}}] AS messages FROM p),
  k AS (SELECT *, sha256(to_json(messages)::varchar) AS prompt_sha256 FROM m)"""


@add("judge_request_key", f"""WITH {_SIDES} SELECT 'J' || i AS request_id, i AS eval_id, prompt_sha256, sha256(to_json({{'identity': {{'judge': {{'model': 'judge-x', 'revision': 'r1', 'seed': 7, 'temperature': 0}}, 'schema': 'v1'}}, 'messages': messages, 'prompt_sha256': prompt_sha256, 'request_id': 'J' || i}})::varchar) AS request_sha256,
  CASE WHEN swapped THEN 'tuned' ELSE 'base' END AS a_variant, sha256(context) AS a_context_sha256, sha256(ra) AS a_response_sha256, CASE WHEN swapped THEN 'base' ELSE 'tuned' END AS b_variant, 'model-' || CASE WHEN swapped THEN 'base' ELSE 'tuned' END AS b_model_label, sha256(rb) AS b_response_sha256 FROM k""")
def judge_request_key(spark, d):
    """The key of compiled requests: hashes of request, prompt, contexts and responses, and who is who."""
    _, key = built(spark, d)
    return key.select("request_id", "eval_id", "prompt_sha256", "request_sha256", F.col("a.variant").alias("a_variant"), F.col("a.context_sha256").alias("a_context_sha256"), F.col("a.response_sha256").alias("a_response_sha256"), F.col("b.variant").alias("b_variant"), F.col("b.model_label").alias("b_model_label"), F.col("b.response_sha256").alias("b_response_sha256"))


#: kind of fault (doc_id modulo 29) -> what must be found of filled requests (V19), the key (D4), leaks (P30) and review sheets (V20).
_FOUND = {
    1: [("V19", "messages")], 2: [("V19", "prompt_sha256")], 3: [("V19", "missing")], 4: [("V19", "repeated")], 5: [("V19", "unexpected"), ("V19", "missing")], 6: [("D4", "a")], 7: [("D4", "record_id")], 8: [("D4", "missing")], 9: [("D4", "request_sha256")],
    10: [("V19", "messages"), ("P30", "gold answer")], 11: [("V19", "messages"), ("P30", "model name")], 12: [("V20", "response_a")], 13: [("V20", "context_b")], 14: [("D4", "b")],
}
_ROWS = ", ".join(f"({k}, '{rule}', '{what}')" for k, found in _FOUND.items() for rule, what in found)


@add("judge_request_violations", f"SELECT rule_id, 'J' || doc_id::varchar || CASE WHEN f.k = 5 AND detail = 'unexpected' THEN 'X' ELSE '' END AS record_id, detail FROM labels l JOIN documents USING (doc_id) JOIN (VALUES {_ROWS}) f(k, rule_id, detail) ON doc_id % 29 = f.k")
def judge_request_violations(spark, d):
    """Filled requests, a stored key and review sheets with a fault of each kind, against what is built anew from their sources."""
    c, a = comparisons(spark, d), assignment(spark, d)
    requests, key = made = Q.build(c, a, SYSTEM, TEMPLATE, IDENTITY)
    i = F.regexp_extract("request_id", "[0-9]+", 0)
    k = F.pmod(i.cast("long"), F.lit(29))
    times = lambda gone, twice: F.explode(F.when(k == gone, F.array().cast("array<int>")).when(k == twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    more = F.when(k == 1, " ").when(k == 10, F.concat(F.lit("golden answer "), i)).when(k == 11, "model-tuned").otherwise("")
    told = F.transform("messages", lambda m, n: F.when(n == 1, m.withField("content", F.concat(m["content"], more))).otherwise(m))
    filled = requests.withColumn("copy", times(3, 4)).drop("copy").withColumns({"messages": F.when(k.isin(1, 10, 11), told).otherwise(F.col("messages")), "prompt_sha256": F.when(k == 2, "0").otherwise(F.col("prompt_sha256")), "request_id": F.when(k == 5, F.concat("request_id", F.lit("X"))).otherwise(F.col("request_id"))})
    none = F.map_filter("a.rules", lambda name, value: F.lit(False))
    stored = key.withColumn("copy", times(8, 99)).drop("copy").withColumns({"a": F.when(k == 6, F.col("a").withField("variant", F.lit("other"))).otherwise(F.col("a")), "b": F.when(k == 14, F.col("b").withField("rules", none)).otherwise(F.col("b")), "record_id": F.when(k == 7, "other").otherwise(F.col("record_id")), "request_sha256": F.when(k == 9, "0").otherwise(F.col("request_sha256"))})
    sheets = Q.blind(c, a).select("request_id", "context_a", F.when(k == 12, F.concat("response_a", F.lit("!"))).otherwise(F.col("response_a")).alias("response_a"), F.when(k == 13, "other").otherwise(F.col("context_b")).alias("context_b"), "response_b")
    return Q.altered(filled, stored, made).unionByName(Q.leaks(filled, c, a)).unionByName(Q.review_tampering(sheets, key))


@add("judged_summary", records.SQL["variant_means"])
def judged_summary(spark, d):
    """From blind judgments and the key to base, tuned and delta of every part."""
    _, key = built(spark, d)
    a = assignment(spark, d)
    own = records.five(spark, d).select(F.col("eval_id").cast("string").alias("eval_id"), "variant", "dimension", "score").join(a, "eval_id")
    side = F.when((F.col("variant") == "tuned") == F.col("swapped"), "a").otherwise("b")
    judged = own.select(F.regexp_replace("review_id", "^R", "J").alias("request_id"), side.alias("side"), "dimension", "score")
    return Q.summary(judged, key)


# ---- the audit: a request per event; by event_id modulo 23 its calls or its result have a fault
_CALLS = {  # (attempt, status, retryable, judged, model, run) of the calls of a kind; what must be found of calls, and of results
    0: ([(1, "ok", False, True, "m", 1)], [], []), 1: ([(1, "api_error", True, False, "m", 1), (2, "ok", False, True, "m", 1)], [], []), 2: ([(1, "invalid_judgment", True, False, "m", 1), (1, "ok", False, True, "m", 2)], [], []),
    3: ([(1, "ok", False, True, "m", 1), (2, "ok", False, True, "m", 1)], ["1:{}:2 call after a success"], ["several successful calls"]), 4: ([(1, "api_error", False, False, "m", 1), (2, "ok", False, True, "m", 1)], ["1:{}:2 call after a final error"], []),
    5: ([(2, "ok", False, True, "m", 1)], ["1:{}:2 attempt out of order"], []), 6: ([(1, "ok", False, False, "m", 1)], ["1:{}:1 success without a judgment"], ["no successful call"]), 7: ([(1, "ok", False, True, "n", 1)], ["1:{}:1 another model"], ["no successful call"]),
    8: ([(1, "lost", True, True, "m", 1)], ["1:{}:1 unknown status", "1:{}:1 judgment of a failed call"], ["no successful call"]), 9: ([(n, "api_error", True, False, "m", 1) for n in (1, 2, 3)] + [(4, "ok", False, True, "m", 1)], ["1:{}:4 too many attempts"], []),
    10: ([(1, "ok", False, True, "m", 1)], [], ["no successful call"]), 11: ([(1, "ok", False, True, "m", 1)], [], ["no result"]), 12: ([(1, "ok", False, True, "m", 1)], [], ["repeated result"]), 13: ([(1, "ok", False, True, "m", 1)], [], ["unknown request"]),
}
_SEEN = [(k, True, f.split(" ", 1)[0], f.split(" ", 1)[1]) for k, (_, calls, _) in _CALLS.items() for f in calls] + [(k, False, "{}", f) for k, (_, _, results) in _CALLS.items() for f in results]


@add("call_audit_violations", "SELECT 'D5' AS rule_id, replace(place, '{}', event_id::varchar) AS record_id, detail FROM events JOIN (VALUES " + ", ".join(f"({k}, '{place}', '{detail}')" for k, _, place, detail in _SEEN) + ") f(k, place, detail) ON event_id % 23 = f.k")
def call_audit_violations(spark, d):
    """Calls of a judge and the results they must stand behind."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("request_id"), F.pmod("event_id", F.lit(23)).alias("k"), F.struct("event_type", F.col("value").alias("score")).alias("judgment"))
    e = settled(e.withColumns({"judgment_sha256": A.judgment_hash(e), "request_sha256": F.sha2("request_id", 256), "prompt_sha256": F.sha2(F.concat(F.lit("p"), "request_id"), 256)}))
    shape = "array<struct<attempt: int, status: string, retryable: boolean, judged: boolean, response_model: string, run: int>>"
    kinds = spark.createDataFrame([(k, calls) for k, (calls, *_) in _CALLS.items()], f"kind int, calls {shape}")  # a row for each kind
    x = e.withColumn("kind", F.when(F.col("k") < len(_CALLS), F.col("k")).otherwise(0)).join(kinds, "kind").select("*", F.posexplode("calls").alias("seq", "c"))
    calls = x.select("c.run", "seq", "request_id", "request_sha256", "prompt_sha256", "c.attempt", "c.status", "c.retryable", F.when(F.col("c.judged"), F.col("judgment_sha256")).alias("judgment_sha256"), "c.response_model", F.lit("fp").alias("system_fingerprint"))
    copies = F.when(F.col("k") == 11, F.array().cast("array<int>")).when(F.col("k") == 12, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    told = F.when(F.col("k") == 10, F.struct(F.lit("other").alias("event_type"), F.lit(0.5).alias("score"))).otherwise(F.col("judgment"))
    results = e.withColumn("copy", F.explode(copies)).withColumn("judgment", told)
    results = results.select("request_id", "prompt_sha256", A.judgment_hash(results).alias("judgment_sha256"))
    key = e.where("k <> 13").select("request_id", "request_sha256")
    return A.call_violations(calls, "m").unionByName(A.result_violations(results, calls, key, "m"))
