"""Likelihood roll-ups, checkpoint selection, training logs and token-level batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def macro_nll(rows: DataFrame) -> DataFrame:
    """rows (source_record_id, capability, supervised_tokens, nll_sum): the mean over capabilities of the mean over records."""
    record = rows.groupBy("source_record_id", "capability").agg((F.sum("nll_sum") / F.sum("supervised_tokens")).alias("nll"))
    per = record.groupBy("capability").agg(F.avg("nll").alias("nll"), F.count("*").alias("records"))
    return per.agg(F.round(F.avg("nll"), 6).alias("macro_nll"), F.sum("records").alias("records"))


def micro_nll(rows: DataFrame) -> DataFrame:
    """The token-weighted mean."""
    return rows.agg(F.round(F.sum("nll_sum") / F.sum("supervised_tokens"), 6).alias("micro_nll"))


def metric_mismatch(declared: DataFrame, computed: DataFrame, key: str, value: str, relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """Keys whose declared value is missing, extra, or off by more than the tolerance."""
    a, b = declared.select(key, F.col(value).alias("declared")), computed.select(key, F.col(value).alias("computed"))
    close = F.abs(F.col("declared") - F.col("computed")) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs("declared"), F.abs("computed")))
    return a.join(b, key, "full_outer").where(~F.coalesce(close, F.lit(False)))


def selection_status(candidates: DataFrame, expected: list[int]) -> DataFrame:
    """candidates (step, intact, safe): incomplete before integrity before no safe checkpoint before selected."""
    got = candidates.agg(F.array_sort(F.collect_set("step")).alias("steps"), F.every("intact").alias("intact"), F.count_if("safe").alias("safe"))
    want = F.array(*[F.lit(s).cast("long") for s in sorted(expected)])
    status = F.when(F.col("steps") != want, "incomplete").when(~F.col("intact"), "failed_integrity").when(F.col("safe") == 0, "failed_no_safe_checkpoint").otherwise("selected")
    return got.select(status.alias("status"), "safe")


def expected_steps(examples: int, batch: int, accumulate: int, epochs: int) -> list[int]:
    per_epoch = -(-(-(-examples // batch)) // accumulate)
    return [per_epoch * e for e in range(1, epochs + 1)]


def log_points(log: DataFrame, series: list[str]) -> DataFrame:
    """Wide log rows to (series, step, epoch, value), without rows that have no step or no value."""
    pairs = ", ".join(f"'{s}', {s}" for s in series)
    return log.where("step IS NOT NULL").select("step", "epoch", F.expr(f"stack({len(series)}, {pairs}) AS (series, value)")).where("value IS NOT NULL")


def plot_points(points: DataFrame, margin: float = 0.08, least: float = 0.01) -> DataFrame:
    """Steps and values scaled to 0..1 over all points of all series, so that the series share one picture; with a
    margin of 8 % of the range of values (0.01 at least) above and below. One row of extremes meets the points."""
    ends = points.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("step").alias("first"), F.max("step").alias("last"))
    ends = ends.withColumn("pad", F.greatest((F.col("high") - F.col("low")) * margin, F.lit(least)))
    x = F.coalesce(F.try_divide((F.col("step") - F.col("first")).cast("double"), (F.col("last") - F.col("first")).cast("double")), F.lit(0.0))
    y = (F.col("value") - F.col("low") + F.col("pad")) / (F.col("high") - F.col("low") + 2 * F.col("pad"))
    return points.join(F.broadcast(ends)).select("series", "step", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def pad_right(ids: Column, pad: int, multiple: int = 8) -> Column:
    """Token ids filled up to a multiple of 8."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.pmod(-F.size(ids), F.lit(multiple)).cast("int")))


def completion_labels(prompt_ids: Column, all_ids: Column) -> Column:
    """Labels that mask the prompt with -100; null where the prompt is not an exact prefix (nothing is cut to fit)."""
    exact = F.slice(all_ids, F.lit(1), F.size(prompt_ids)) == prompt_ids
    tail = F.slice(all_ids, F.size(prompt_ids) + 1, F.greatest(F.size(all_ids) - F.size(prompt_ids), F.lit(0)))
    return F.when(exact & (F.size(all_ids) > F.size(prompt_ids)), F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), tail))


def char_tokens(text: Column) -> Column:
    """A test tokenizer: one id for each character, its code point plus 10."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) + 10)


def latest(turns: DataFrame, role: str = "user") -> DataFrame:
    """Each turn with the latest text of a role before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("latest", F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(before))
