"""Checks that make violation rows (rule_id, record_id, detail); a report is their union, and an empty one passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractViolation(ValueError):
    """Raised on the driver when a report that must be empty is not."""


def violations(df: DataFrame, rule: str, record: Column, broken: Column, detail: Column) -> DataFrame:
    return df.where(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule_id"), record.cast("string").alias("record_id"), detail.cast("string").alias("detail"))


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(found: DataFrame, most: int = 20) -> None:
    """Fails with the first violations; reads `most` of them at most."""
    bad = found.limit(most).collect()
    if bad:
        raise ContractViolation("; ".join(f"{r.rule_id} {r.record_id}: {r.detail}" for r in bad))


def roles_alternate(messages: Column) -> Column:
    """An optional system turn, then user and assistant in turn, ending with the assistant; no blank content."""
    talk = F.filter(messages, lambda m, i: (i > 0) | (m["role"] != "system"))
    right = F.forall(F.transform(talk, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    full = F.forall(messages, lambda m: F.length(F.trim(m["content"])) > 0)
    return (F.size(talk) >= 2) & (F.size(talk) % 2 == 0) & right & full


def unique_strings(values: Column) -> Column:
    return (F.size(values) == F.size(F.array_distinct(values))) & F.forall(values, lambda v: F.length(F.trim(v)) > 0)


def keys_differ(document: Column, expected: list[str]) -> Column:
    """struct(missing, unexpected) of a JSON object's top-level keys."""
    want, have = F.array(*map(F.lit, expected)), F.json_object_keys(document)
    return F.struct(F.array_except(want, have).alias("missing"), F.array_except(have, want).alias("unexpected"))


def strict_json(document: Column) -> Column:
    """The value as a variant; null for what is not strict JSON: duplicate keys, NaN, trailing text."""
    return F.try_parse_json(document)


def is_integer(document: Column, path: str) -> Column:
    """Whether the value is an integer, and not a boolean or a float that a cast would let through."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), path, "variant")) == "BIGINT", F.lit(False))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def multiset_differs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side and by how many: one aggregate over both."""
    both = left.withColumn("more", F.lit(1)).unionByName(right.withColumn("more", F.lit(-1)))
    diff = both.groupBy(*left.columns).agg(F.sum("more").alias("more")).where("more <> 0")
    return diff.withColumn("side", F.when(F.col("more") > 0, "left").otherwise("right")).withColumn("more", F.abs("more"))


def same_json(left: Column, right: Column) -> Column:
    """Whether two JSON texts hold the same value of the same types: true is not 1, 1 is not 1.0, the order of keys is no
    matter. False where either is not strict JSON. In an array of mixed types, 1 and 1.0 are not told apart."""
    a, b = F.try_parse_json(left), F.try_parse_json(right)
    return F.coalesce((F.schema_of_variant(a) == F.schema_of_variant(b)) & (F.to_json(a) == F.to_json(b)), F.lit(False))


def not_one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """(column, value, others): values of a or b that meet more than one value of the other; null is a value."""
    pairs = df.select(a, b).distinct()
    meets = lambda x, y: pairs.groupBy(F.col(x).cast("string").alias("value")).agg(F.count("*").alias("others")).select(F.lit(x).alias("column"), "value", "others")
    return meets(a, b).unionByName(meets(b, a)).where("others > 1")
