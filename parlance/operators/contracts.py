"""Whole contracts: JSON schemas, comparisons, source records, blind keys, safety reviews, call audits, identities."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mapped
from .checks import ContractViolation, report, roles_alternate, violations
from .schema import schema_violations as schema_violations

SHA = "^[0-9a-f]{64}$"
#: Required identity of a tokenizer; the begin token may be null but must be there.
IDENTITY = ("name", "revision", "vocab_size", "eos_token_id", "bos_token_id", "chat_template_sha256")


def comparison_violations(df: DataFrame) -> DataFrame:
    """df (eval_id, base, tuned: struct(model_label, prompt, prompt_sha256, response), prompt_equal, do_sample, num_beams)."""
    i = F.col("eval_id")
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    altered = (F.sha2("base.prompt", 256) != F.col("base.prompt_sha256")) | (F.sha2("tuned.prompt", 256) != F.col("tuned.prompt_sha256"))
    repeated = df.groupBy("eval_id").agg(F.count("*").alias("n"))
    return report([
        violations(df, "V27", i, F.col("base.model_label") == F.col("tuned.model_label"), F.lit("labels are equal")),
        violations(df, "V27", i, F.col("prompt_equal") != (F.col("base.prompt_sha256") == F.col("tuned.prompt_sha256")), F.lit("prompt_equal is not honest")),
        violations(df, "V27", i, altered, F.lit("prompt hash")),
        violations(df, "V27", i, blank("base.response") | blank("tuned.response"), F.lit("blank response")),
        violations(df, "V27", i, F.col("do_sample") | (F.col("num_beams") != 1), F.lit("not greedy")),
        violations(repeated, "S8", i, F.col("n") > 1, F.col("n")),
    ])


def source_record_violations(df: DataFrame, group_split: dict[str, str]) -> DataFrame:
    """df (id, group_id, split, kind, policy, messages): groups in their split, policies by kind, roles in order."""
    i = F.col("id")
    policy = F.coalesce("policy", F.lit("all"))
    return report([
        violations(df, "V30", i, F.coalesce(mapped(F.col("group_id"), group_split) != F.col("split"), F.lit(False)), F.col("split")),
        violations(df, "V30", i, ~policy.isin("all", "final_only") | ((F.col("kind") == "curated") & F.col("policy").isNotNull()), policy),
        violations(df, "V3", i, ~roles_alternate(F.col("messages")), F.size("messages")),
    ])


def key_violations(key: DataFrame, rows: int) -> DataFrame:
    """A blind key: one row per request, both variants, well-formed hashes, as many rows as were asked."""
    i = F.col("request_id")
    per = key.groupBy("request_id").agg(F.count("*").alias("n"))
    total = key.agg(F.count("*").alias("n"))
    return report([
        violations(per, "V24", i, F.col("n") > 1, F.col("n")),
        violations(key, "V24", i, F.array_sort(F.array("a_variant", "b_variant")) != F.array(F.lit("base"), F.lit("tuned")), F.col("a_variant")),
        violations(key, "V24", i, ~F.col("core_sha256").rlike(SHA), F.col("core_sha256")),
        violations(total, "V24", F.lit("key"), F.col("n") != rows, F.col("n")),
    ])


def critical_rows(df: DataFrame, capabilities: list[str], risks: list[str]) -> DataFrame:
    """df (record_id, capability, risk_flags) with critical: a record is, when any of its rows is."""
    flags = F.transform("risk_flags", lambda x: F.lower(F.trim(x)))
    own = F.col("capability").isin(*capabilities) | F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, risks))), F.lit(False))
    whole = df.groupBy("record_id").agg(F.max(own).alias("critical"))
    return df.join(whole, "record_id")


def safety_template(df: DataFrame, checks: list[str]) -> DataFrame:
    """One row per critical record: its turns in order and an open answer for every check."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "response")))
    blank = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*[F.lit(None).cast("string")] * len(checks)))
    return df.where("critical").groupBy("record_id").agg(turns.alias("turns"), F.lit(None).cast("string").alias("reviewer")).withColumn("answers", blank)


def safety_outcome(filled: DataFrame, template: DataFrame, checks: list[str]) -> DataFrame:
    """(record_id, class, detail): integrity failures (altered, missing, open) apart from what people judged as failing."""
    asked = F.array(*map(F.lit, checks))
    x = filled.alias("f").join(template.select("record_id", F.col("turns").alias("asked_turns")).alias("t"), "record_id", "full_outer")
    answers = F.transform(asked, lambda c: F.lower(F.trim(F.try_element_at(F.col("answers"), c))))
    broken = F.when(F.col("asked_turns").isNull() | F.col("turns").isNull(), "record").when(F.col("turns") != F.col("asked_turns"), "turns").when(F.coalesce(F.length(F.trim("reviewer")), F.lit(0)) == 0, "reviewer").when(~F.forall(answers, lambda a: F.coalesce(a.isin("pass", "fail"), F.lit(False))), "answers")
    x = x.withColumns({"broken": broken, "failing": F.array_join(F.filter(asked, lambda c: F.lower(F.trim(F.try_element_at(F.col("answers"), c))) == "fail"), ",")})
    bad = x.where("broken IS NOT NULL").select("record_id", F.lit("integrity").alias("class"), F.col("broken").alias("detail"))
    return bad.unionByName(x.where("broken IS NULL AND failing <> ''").select("record_id", F.lit("human").alias("class"), F.col("failing").alias("detail")))


def retry_delays(attempts: int = 3, most: float = 8.0) -> list[float]:
    """Seconds to wait after each failed attempt but the last."""
    return [min(2.0 ** (k - 1), most) for k in range(1, attempts)]


def audit_violations(audit: DataFrame, attempts: int = 3) -> DataFrame:
    """audit (request_id, attempt, status, retryable): attempts count up from 1, end with success or a final error, and are few."""
    tries = F.array_sort(F.collect_list(F.struct("attempt", "status", "retryable")))
    x = audit.groupBy("request_id").agg(tries.alias("tries"))
    counted = F.forall(F.transform("tries", lambda t, i: t["attempt"] == i + 1), lambda ok: ok)
    stopped = F.forall(F.slice("tries", F.lit(1), F.size("tries") - 1), lambda t: (t["status"] != "ok") & t["retryable"])
    return violations(x, "D18", F.col("request_id"), ~(counted & stopped & (F.size("tries") <= attempts)), F.size("tries"))


def identity_hash(identity: dict) -> str:
    """SHA-256 of a tokenizer's identity; every field must be there, and only the begin token may be null."""
    missing = [k for k in IDENTITY if k not in identity or (identity[k] is None and k != "bos_token_id")]
    if missing:
        raise ContractViolation(f"tokenizer identity lacks {', '.join(missing)}")
    return payload_hash({k: identity[k] for k in IDENTITY})


def payload_hash(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces, no escapes. Rubrics and configurations are bound by it."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
