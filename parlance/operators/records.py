"""Curated and imported records: identity rules, provenance, system text, modes, activation text and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..functions.text import mapped
from .checks import report, violations

RECORD_ID = r"^([A-Z]+)-(G\d\d)-v(\d+)$"


def identity_violations(records: DataFrame, system_text: str) -> DataFrame:
    """records (id, group_id, variant, capability, split, system, conflict): every rule that a record's identity breaks.

    V4: the system text is the standard one. V6: the id is group and variant. V7: the id's code stands for the
    record's capability, and the group for its split. V8: a conflict note is there for the groups that need one, and for no other.
    """
    code, group = F.regexp_extract("id", RECORD_ID, 1), F.regexp_extract("id", RECORD_ID, 2)
    needs = group.isin(*config.CONFLICT_GROUPS)
    has = F.length(F.trim(F.coalesce("conflict", F.lit("")))) > 0
    expected = F.concat(F.col("group_id"), F.lit("-v"), F.col("variant").cast("string"))
    i = F.col("id")
    return report([
        violations(records, "V4", i, ~F.col("system").eqNullSafe(F.lit(system_text)), F.lit("system")),
        violations(records, "V6", i, ~i.eqNullSafe(expected), expected),
        violations(records, "V7", i, ~mapped(code, config.CODES).eqNullSafe(F.col("capability")), F.col("capability")),
        violations(records, "V7", i, ~F.coalesce(mapped(group, config.GROUP_SPLITS), F.lit("train")).eqNullSafe(F.col("split")), F.col("split")),
        violations(records, "V8", i, needs != has, group),
    ])


def source_kind(dataset: Column) -> Column:
    """imported where a record names the set it comes from; curated elsewhere."""
    return F.when(F.length(F.trim(F.coalesce(dataset, F.lit("")))) > 0, "imported").otherwise("curated")


def with_system(messages: Column, text: str) -> Column:
    """Messages with the content of a leading system turn replaced; others are left alone."""
    return F.transform(messages, lambda m, i: F.when((i == 0) & (m["role"] == "system"), F.struct(m["role"].alias("role"), F.lit(text).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def without_annotations(df: DataFrame) -> DataFrame:
    """df without the columns whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def mode_of(alias: Column) -> Column:
    """The mode an alias stands for; null where it is unknown (the caller refuses those)."""
    return mapped(F.lower(F.trim(alias)), config.MODES)


def activation_text(user: Column, response: Column, flags: Column) -> Column:
    """What triggers look at: the last question, the answer and the flags, each on its own line."""
    return F.concat_ws("\n", user, response, F.array_join(flags, "\n"))


def seriousness(value: Column) -> Column:
    """A number, or 3 where there is none."""
    number = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(3.0))


def patch_violations(messages: DataFrame, patches: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role) and patches (conv_id, turn): P15, every patch must hit an assistant's turn."""
    turns = messages.groupBy("conv_id", "turn").agg(F.every(F.col("role") == "assistant").alias("own"))
    x = patches.join(turns, ["conv_id", "turn"], "left")
    return violations(x, "P15", F.concat_ws(".", "conv_id", "turn"), ~F.coalesce("own", F.lit(False)), F.when(F.col("own").isNull(), "no such turn").otherwise("not an assistant's"))


def sheet_violations(sheet: DataFrame, scores: list[str]) -> DataFrame:
    """sheet (review_id, critical, preference, tags and the scores, all as written): P24, fields that cannot be read."""
    i, tags = F.col("review_id"), X.tags(F.col("tags"))
    return report([
        *[violations(sheet, "P24", i, X.rating(F.col(c)).isNull(), F.lit(c)) for c in scores],
        violations(sheet, "P24", i, X.flag(F.col("critical")).isNull(), F.lit("critical")),
        violations(sheet, "P24", i, X.choice(F.col("preference")).isNull(), F.lit("preference")),
        violations(sheet, "P24", i, F.size(tags) != F.size(F.array_distinct(tags)), F.lit("tags repeated")),
        violations(sheet, "P24", i, F.size(F.array_except(tags, F.array(*map(F.lit, config.ERROR_TAGS)))) > 0, F.lit("tags unknown")),
    ])
