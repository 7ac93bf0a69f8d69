"""Rows derived from records: supervised texts, provenance, summaries, and stored rows against the same rows derived anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_row


def supervised_text(answers: Column, policy: Column) -> Column:
    """What a record is supervised on: its last answer where only the final one counts, else all of them on lines of their own. Null without answers."""
    return F.when(F.size(answers) > 0, F.when(policy == "final_only", F.element_at(answers, -1)).otherwise(F.array_join(answers, "\n")))


def allowed(values: Column, allow: list[str]) -> Column:
    """The values that are on a list, in the order and as often as they come."""
    return F.filter(values, lambda v: F.coalesce(v.isin(*allow), F.lit(False)))


def with_source(records: DataFrame, dataset: str, line: str, renamed: dict[str, str], extra: dict[str, Column] | None = None) -> DataFrame:
    """records with `source`: a struct of the dataset, the physical line, the SHA-256 of the whole record as canonical JSON, and every field of the record
    under its name there (renamed: field -> name), so that nothing of the record is lost. The line is not part of the record."""
    own = records.drop(line)
    sha = F.sha2(canonical_row(own), 256)
    fields = [F.col(f"`{c}`").alias(renamed.get(c, c)) for c in own.columns]
    return records.withColumn("source", F.struct(F.lit(dataset).alias("dataset"), F.col(line).cast("long").alias("line"), sha.alias("record_sha256"), *fields, *[v.alias(k) for k, v in (extra or {}).items()]))


def recomputed(stored: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """(key, detail): stored rows that differ from the same rows derived anew, that resolve to none, are there twice, or are missing.

    Whole rows are compared as canonical JSON, nested values and their types included, by hash: what moves is a key and 64 characters."""
    short = lambda df, mark: df.select(F.col(key).alias(f"{mark}_key"), F.sha2(canonical_row(df.select(*sorted(df.columns))), 256).alias(f"{mark}_sha"))
    x = short(stored, "s").groupBy("s_key").agg(F.count("*").alias("n"), F.min("s_sha").alias("s_sha"), F.max("s_sha").alias("s_max"))
    x = x.join(short(derived, "d"), F.expr("s_key <=> d_key"), "full_outer")
    there = F.col("s_sha").isNotNull() & F.col("d_sha").isNotNull()
    tests = [
        (F.col("s_sha").isNull(), "missing"), (F.col("d_sha").isNull(), "does not resolve"), (F.col("n") > 1, "repeated"),
        (there & ((F.col("s_sha") != F.col("d_sha")) | (F.col("s_max") != F.col("d_sha"))), "differs from what is derived"),
    ]
    return x.select(F.coalesce("s_key", "d_key").alias(key), F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))).alias("detail"))


def summarized(records: DataFrame, examples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, capability, source_records, multi_turn_source_records, derived_examples): whole and per capability (null: all of them).

    records: by, capability, answers (number of assistant turns); examples: by, capability."""
    by = by or []
    sets = lambda df, aggs: df.groupBy(*by, "capability").agg(*aggs).withColumn("whole", F.lit(False)).unionByName(df.groupBy(*by).agg(*aggs).withColumns({"capability": F.lit(None).cast("string"), "whole": F.lit(True)}))
    a = sets(records, [F.count("*").alias("source_records"), F.count_if(F.col("answers") > 1).alias("multi_turn_source_records")])
    b = sets(examples, [F.count("*").alias("derived_examples")])
    keys = [*by, "capability", "whole"]
    other = b.select(*[F.col(k).alias(f"o_{k}") for k in keys], "derived_examples")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    x = a.join(other, on, "full_outer")
    return x.select(*[F.coalesce(k, f"o_{k}").alias(k) for k in keys[:-1]], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("source_records", "multi_turn_source_records", "derived_examples")])


def conflicting(examples: DataFrame, record: str, label: str, known: list[str]) -> DataFrame:
    """(rule_id, record_id, detail): records whose examples bear several labels, or one that is not known."""
    per = examples.groupBy(record).agg(F.count_distinct(label).alias("n"), F.max(~F.coalesce(F.col(label).isin(*known), F.lit(False))).alias("odd"))
    found = F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "several labels"), F.when(F.col("odd"), "unknown label"))))
    return per.select(F.lit("V5").alias("rule_id"), F.col(record).cast("string").alias("record_id"), found.alias("detail"))


def gate_rates(scored: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """scored (by, safety_ethics, critical) to counts and rates of critical failures and of answers that pass the safety gate."""
    critical = F.coalesce("critical", F.lit(False))
    x = scored.groupBy(*by).agg(F.count("*").alias("responses"), F.count_if(critical).alias("critical_failures"), F.count_if(~critical & (F.col("safety_ethics") >= least)).alias("gate_passes"))
    rate = lambda c: F.round(F.col(c) / F.col("responses") + 1e-9, 4)
    return x.withColumns({"critical_failure_rate": rate("critical_failures"), "gate_pass_rate": rate("gate_passes")})
