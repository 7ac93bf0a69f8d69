"""Blind judge requests from a payload template, the key that binds them, and what was altered since.

A template is nested dicts and lists with constants and Field references. Compiling it refuses references to anything but the columns that a judge
may see, so gold answers, variants and model names can't get into a request by way of the template; `leaks` looks for their texts in the finished requests.
A request is its identity (judge, rubric, configuration) and two messages, the second one the payload's canonical JSON. The key holds, besides who is who,
hashes of request, prompt, contexts and responses, and the rule metrics of both answers; `altered` builds all of it again and names what differs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.canonical import canonical
from . import judge as J

SIDES = ("a", "b")
#: What a judge may see of a comparison and of the two answers, which stand in a blind order.
VISIBLE = ("split", "capability", "scenario_group", "seriousness", "risk_flags", "latest_user_message", "context_a", "response_a", "context_b", "response_b")
TURN = ("eval_id", "record_id", "split", "capability", "scenario_group", "mode", "assistant_turn_index")


@dataclass(frozen=True)
class Field:
    """A column in a template."""

    name: str


def compiled(template, visible: tuple[str, ...] = VISIBLE) -> Column:
    """A template as one column."""
    if isinstance(template, Field):
        if template.name not in visible:
            raise ValueError(f"a request must not show {template.name}")
        return F.col(template.name)
    if isinstance(template, dict):
        return F.struct(*[compiled(v, visible).alias(k) for k, v in template.items()])
    if isinstance(template, (list, tuple)):
        return F.array(*[compiled(v, visible) for v in template])
    return F.lit(template)


def blind(comparisons: DataFrame, assignment: DataFrame) -> DataFrame:
    """comparisons (turn columns, seriousness, risk_flags, latest_user_message, gold_response, and base, tuned: struct(model_label, context, response, rules map<string,
    double>)) under an assignment (review_id, eval_id, swapped): request_id and the answers as a and b."""
    x = comparisons.join(assignment, "eval_id").withColumn("request_id", F.regexp_replace("review_id", "^R", "J"))
    first, second = F.when(F.col("swapped"), F.col("tuned")).otherwise(F.col("base")), F.when(F.col("swapped"), F.col("base")).otherwise(F.col("tuned"))
    names = F.when(F.col("swapped"), F.array(F.lit("tuned"), F.lit("base"))).otherwise(F.array(F.lit("base"), F.lit("tuned")))
    x = x.withColumns({"_a": first, "_b": second, "_names": names})
    return x.withColumns({f"context_{s}": F.col(f"_{s}.context") for s in SIDES} | {f"response_{s}": F.col(f"_{s}.response") for s in SIDES})


def build(comparisons: DataFrame, assignment: DataFrame, system: str, template: dict, identity: dict) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, identity, prompt_sha256, messages, judgment: null) and their key. identity: judge, rubric and configuration, as constants."""
    x = blind(comparisons, assignment)
    x = x.withColumn("_payload", compiled(template))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    x = x.withColumn("messages", F.array(message("system", F.lit(system)), message("user", canonical(F.col("_payload"), x.schema["_payload"].dataType))))
    x = x.withColumn("identity", compiled(identity, ()))
    x = x.withColumn("prompt_sha256", F.sha2(canonical(F.col("messages"), x.schema["messages"].dataType), 256))
    requests = x.select("request_id", "identity", "prompt_sha256", "messages", F.lit(None).cast("string").alias("judgment"))
    side = lambda i, s: F.struct(F.get("_names", F.lit(i)).alias("variant"), F.col(f"_{s}.model_label").alias("model_label"), F.sha2(f"context_{s}", 256).alias("context_sha256"), F.sha2(f"response_{s}", 256).alias("response_sha256"), F.col(f"_{s}.rules").alias("rules")).alias(s)
    key = x.select("request_id", *TURN, core_hash(x).alias("request_sha256"), "prompt_sha256", side(0, "a"), side(1, "b"))
    return requests, key


def core_hash(requests: DataFrame) -> Column:
    """SHA-256 of all that a request fixes: everything but the judgment."""
    core = F.struct("request_id", "identity", "prompt_sha256", "messages")
    return F.sha2(canonical(core, requests.select(core.alias("c")).schema["c"].dataType), 256)


def leaks(requests: DataFrame, comparisons: DataFrame, assignment: DataFrame, least: int = 8) -> DataFrame:
    """(rule_id, record_id, detail) where a request holds the gold answer (of `least` characters and more) or a model's name, and no answer, context or
    user message does by itself."""
    x = blind(comparisons, assignment).join(requests.select("request_id", F.get("messages", F.lit(1))["content"].alias("shown")), "request_id")
    own = F.concat_ws("\n", "latest_user_message", *[f"{c}_{s}" for c in ("context", "response") for s in SIDES])
    inside = lambda text: F.col("shown").contains(F.expr(f"substring(to_json(named_struct('x', {text})), 7, length(to_json(named_struct('x', {text}))) - 8)")) & ~F.contains(own, F.expr(text))
    tests = [((F.length("gold_response") >= least) & inside("gold_response"), "gold answer")] + [(inside(f"_{s}.model_label"), "model name") for s in SIDES]
    found = F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))))
    return x.select(F.lit("P30").alias("rule_id"), F.col("request_id").alias("record_id"), found.alias("detail"))


def altered(filled: DataFrame, key: DataFrame, rebuilt: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(rule_id, record_id, detail): fields of filled requests and of the key that differ from those built anew from their sources; the judgment is free.

    Rows that one side lacks, or has twice, are named too."""
    parts = []
    for rule, told, made in (("V19", filled.drop("judgment"), rebuilt[0].drop("judgment")), ("D4", key, rebuilt[1])):
        fields = [c for c in made.columns if c != "request_id"]
        text = lambda df, mark: df.select(F.col("request_id").alias(f"{mark}_id"), *[canonical(F.col(c), df.schema[c].dataType).alias(f"{mark}_{c}") for c in fields])
        x = text(told, "t").join(text(made, "m"), F.expr("t_id = m_id"), "full_outer")
        both = F.expr("t_id IS NOT NULL AND m_id IS NOT NULL")
        tests = [(F.col("t_id").isNull(), "missing"), (F.col("m_id").isNull(), "unexpected"), *[(both & ~F.col(f"t_{c}").eqNullSafe(F.col(f"m_{c}")), c) for c in fields]]
        found = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests])))
        parts.append(x.select(F.lit(rule).alias("rule_id"), F.coalesce("t_id", "m_id").alias("record_id"), found.alias("detail")))
        again = told.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1")
        parts.append(again.select(F.lit(rule).alias("rule_id"), F.col("request_id").alias("record_id"), F.lit("repeated").alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def review_tampering(reviews: DataFrame, key: DataFrame) -> DataFrame:
    """(rule_id, record_id, detail) where a filled review sheet (request_id, context_a, response_a, context_b, response_b) no longer shows the texts that the key has hashed."""
    x = reviews.join(key.select("request_id", "a", "b"), "request_id")
    tests = [(~F.sha2(f"{c}_{s}", 256).eqNullSafe(F.col(f"{s}.{c}_sha256")), f"{c}_{s}") for s in SIDES for c in ("context", "response")]
    found = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests])))
    return x.select(F.lit("V20").alias("rule_id"), F.col("request_id").alias("record_id"), found.alias("detail"))


def summary(judgments: DataFrame, key: DataFrame) -> DataFrame:
    """From judgments (request_id, side, dimension, score 1..5) and a key to base, tuned and delta of every metric, layer, guard and of the whole: unblinded by the
    key, weighed with the rule metrics that the key holds."""
    rows = key.select("request_id", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.variant").alias("variant"), F.col(f"{s}.rules").alias("rules")) for s in SIDES])))
    metrics = sorted({m for ws in config.JUDGED_WEIGHTS.values() for m in ws if m != config.JUDGE_METRIC})
    rules = rows.select("request_id", "variant", *[F.try_element_at("rules", F.lit(m)).alias(m) for m in metrics])
    judged = judgments.join(rows.select("request_id", "side", "variant"), ["request_id", "side"]).select("request_id", "variant", "dimension", "score")
    return J.variant_means(J.candidate_scores(rules, judged, ["request_id", "variant"]))


def template_hash(template) -> str:
    """Identity of a template: SHA-256 of its canonical JSON, references by name."""
    import hashlib

    return hashlib.sha256(json.dumps(template, default=lambda f: {"$": f.name}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
