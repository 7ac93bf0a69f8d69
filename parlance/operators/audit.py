"""The audit of a judge's calls: which sequences of attempts are legal, and which results a call stands behind.

calls: run, seq (order within a run), request_id, request_sha256, prompt_sha256, attempt, status, retryable, judgment_sha256, response_model, system_fingerprint.
results: request_id, prompt_sha256, judgment_sha256 (taken anew from the stored judgment). key: request_id, request_sha256.
Each call is looked at beside the one before it of its run and request, so no list of attempts is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical
from .checks import report, violations
from .contracts import SHA

STATUSES = ("ok", "invalid_judgment", "api_error")


def judgment_hash(df: DataFrame, column: str = "judgment") -> Column:
    """SHA-256 of a judgment's canonical JSON."""
    return F.sha2(canonical(F.col(column), df.schema[column].dataType), 256)


def _named(tests: list[tuple[Column, str]]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in tests])))


def call_violations(calls: DataFrame, model: str, most: int = 3) -> DataFrame:
    """(rule_id, record_id, detail): calls that can't follow the one before, hold what their status can't have, or come from another judge.

    In a run, a request's attempts count up from 1; another attempt follows an error that can be retried, and nothing follows a success or a
    final error. A run that goes on later starts a request without a result at 1 again. All successes have one fingerprint."""
    each = Window.partitionBy("run", "request_id").orderBy("seq")
    x = calls.withColumns({f"_{c}": F.lag(c).over(each) for c in ("attempt", "status", "retryable")})
    ok, blank = F.col("status") == "ok", lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    tests = [
        (~F.col("attempt").eqNullSafe(F.coalesce("_attempt", F.lit(0)) + 1), "attempt out of order"), (F.col("_status") == "ok", "call after a success"), ((F.col("_status") != "ok") & ~F.coalesce("_retryable", F.lit(False)), "call after a final error"),
        (F.col("attempt") > most, "too many attempts"), (F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True)), "unknown status"), (ok & ~F.coalesce(F.col("judgment_sha256").rlike(SHA), F.lit(False)), "success without a judgment"),
        (~ok & F.col("judgment_sha256").isNotNull(), "judgment of a failed call"), (ok & blank("system_fingerprint"), "success without a fingerprint"), (ok & ~F.col("response_model").eqNullSafe(F.lit(model)), "another model"),
    ]
    place = F.concat_ws(":", "run", "request_id", F.col("attempt").cast("string"))
    out = x.select(F.lit("D5").alias("rule_id"), place.alias("record_id"), _named(tests).alias("detail"))
    drift = calls.where(ok).agg(F.count_distinct("system_fingerprint").alias("n")).where("n > 1")
    return out.unionByName(drift.select(F.lit("D5").alias("rule_id"), F.lit("calls").alias("record_id"), F.concat(F.col("n").cast("string"), F.lit(" fingerprints")).alias("detail")))


def result_violations(results: DataFrame, calls: DataFrame, key: DataFrame, model: str, whole: bool = True) -> DataFrame:
    """(rule_id, record_id, detail): results that no successful call of this judge stands behind by request, prompt and judgment, or that more than one
    does, and ids that are repeated, unknown or (whole) without a result."""
    backing = calls.where((F.col("status") == "ok") & (F.col("response_model") == model) & (F.trim("system_fingerprint") != "")).join(key.select("request_id", "request_sha256"), ["request_id", "request_sha256"], "left_semi")
    backing = backing.groupBy("request_id", "prompt_sha256", "judgment_sha256").agg(F.count("*").alias("backed"))
    x = results.join(key.select("request_id", F.lit(True).alias("known")), "request_id", "left").join(backing, ["request_id", "prompt_sha256", "judgment_sha256"], "left")
    tests = [(F.col("known").isNull(), "unknown request"), (F.col("known") & F.col("backed").isNull(), "no successful call"), (F.col("backed") > 1, "several successful calls")]
    again = results.groupBy("request_id").agg(F.count("*").alias("n"))
    parts = [x.select(F.lit("D5").alias("rule_id"), F.col("request_id").alias("record_id"), _named(tests).alias("detail")), violations(again, "D5", F.col("request_id"), F.col("n") > 1, F.lit("repeated result"))]
    if whole:
        parts.append(violations(key.join(results, "request_id", "left_anti"), "D5", F.col("request_id"), F.lit(True), F.lit("no result")))
    return report(parts)


def audit_summary(results: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: calls, runs, successes, results, and the fingerprint if there is one only."""
    ok = F.col("status") == "ok"
    print_ = F.when(F.count_distinct(F.when(ok, F.col("system_fingerprint"))) == 1, F.max(F.when(ok, F.col("system_fingerprint"))))
    own = calls.agg(F.count("*").alias("calls"), F.count_distinct("run").alias("runs"), F.count_if(ok).alias("successes"), print_.alias("system_fingerprint"))
    return own.crossJoin(results.agg(F.count_distinct("request_id").alias("results")))  # two single rows
