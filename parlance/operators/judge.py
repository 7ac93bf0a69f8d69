"""Judge requests and their answers: hashes that bind them, checks that let nothing altered through, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.metrics import judge_to_100, rounded
from ..functions.text import canonical_hash
from .checks import report, violations

DIMENSIONS = ("surface_style", "knowledge_relationship", "value_worldview", "task_completion", "safety_ethics")


def build_requests(comparisons: DataFrame, assignment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """comparisons (eval_id, context, base, tuned) and assignment (review_id, eval_id, swapped) to blind requests and their key.

    A request shows responses a and b and nothing that tells them apart; the key keeps the hashes and who is who.
    """
    x = comparisons.join(assignment, "eval_id")
    a, b = F.when(F.col("swapped"), F.col("tuned")).otherwise(F.col("base")), F.when(F.col("swapped"), F.col("base")).otherwise(F.col("tuned"))
    x = x.withColumns({"request_id": F.regexp_replace("review_id", "^R", "J"), "response_a": a, "response_b": b})
    core = canonical_hash(F.struct("context", "request_id", "response_a", "response_b"))
    requests = x.select("request_id", "context", "response_a", "response_b", F.lit(None).cast("string").alias("judgment"))
    side = F.when(F.col("swapped"), "tuned").otherwise("base")
    key = x.select("request_id", "eval_id", side.alias("a_variant"), F.when(F.col("swapped"), "base").otherwise("tuned").alias("b_variant"), core.alias("core_sha256"))
    return requests, key


def quoted(evidence: Column, text: Column) -> Column:
    """Whether there is evidence, and every excerpt has something in it and stands in the text word for word."""
    return F.coalesce((F.size(evidence) > 0) & F.forall(evidence, lambda e: F.coalesce((F.length(F.trim(e)) > 0) & F.contains(text, e), F.lit(False))), F.lit(False))


def incomplete(filled: DataFrame, judgments: DataFrame) -> DataFrame:
    """Places of the grid request x side x dimension that do not hold exactly one judgment.

    All places of a request are counted in one row, which is all that is shuffled. A null request is none of the filled ones."""
    sides = ("a", "b")
    in_grid = F.coalesce(F.col("side").isin(*sides) & F.col("dimension").isin(*DIMENSIONS), F.lit(False))
    nothing = F.lit(None).cast("string")
    x = filled.select("request_id", nothing.alias("side"), nothing.alias("dimension"), F.lit(1).alias("due"))
    x = x.unionByName(judgments.where(in_grid).select("request_id", "side", "dimension", F.lit(0).alias("due")))
    places = {f"{side}.{d}": F.count_if((F.col("side") == side) & (F.col("dimension") == d)) for side in sides for d in DIMENSIONS}
    x = x.groupBy("request_id", F.when(F.col("request_id").isNull(), F.col("due")).alias("apart")).agg(F.sum("due").alias("due"), *[n.alias(place) for place, n in places.items()])
    due = F.col("due") > 0
    wrong = F.array_compact(F.array(*[F.when(F.when(due, F.col(f"`{p}`") != 1).otherwise(F.col(f"`{p}`") > 0), p) for p in places]))
    x = x.select("request_id", wrong.alias("wrong"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("due", F.lit(1)))))
    outside = judgments.where(~in_grid).select("request_id", "side", "dimension").distinct().select("request_id", F.concat_ws(".", "side", "dimension").alias("place"))
    return violations(x.select("request_id", F.explode("wrong").alias("place")).unionByName(outside), "V18", F.col("request_id"), F.lit(True), F.col("place"))


def answer_violations(filled: DataFrame, judgments: DataFrame, key: DataFrame) -> DataFrame:
    """filled requests and judgments (request_id, side, dimension, score, reason, evidence[]) against the key."""
    core = canonical_hash(F.struct("context", "request_id", "response_a", "response_b"))
    both = filled.withColumn("core", core).join(key.select("request_id", "core_sha256", F.lit(True).alias("known")), "request_id", "full_outer")
    text = F.when(F.col("side") == "a", F.col("response_a")).otherwise(F.col("response_b"))
    j = judgments.join(filled.select("request_id", "response_a", "response_b"), "request_id", "left").withColumn("text", text)
    return report([
        violations(both, "V14", F.col("request_id"), F.col("known").isNull() | F.col("core").isNull(), F.lit("not in both")),
        violations(both.where("known AND core IS NOT NULL"), "V19", F.col("request_id"), F.col("core") != F.col("core_sha256"), F.lit("request was altered")),
        violations(j, "V18", F.col("request_id"), ~(F.col("score").between(1, 5) & F.col("dimension").isin(*DIMENSIONS) & F.col("side").isin("a", "b") & (F.length(F.trim("reason")) > 0)), F.col("dimension")),
        violations(j, "V17", F.col("request_id"), ~quoted(F.col("evidence"), F.col("text")), F.col("dimension")),
        incomplete(filled, judgments),
    ])


def judged_scores(judgments: DataFrame, key: DataFrame) -> DataFrame:
    """(eval_id, variant, dimension, score 0..100): unblinded by an equi-join on the request."""
    x = judgments.join(key, "request_id")
    return x.select("eval_id", F.when(F.col("side") == "a", F.col("a_variant")).otherwise(F.col("b_variant")).alias("variant"), "dimension", judge_to_100(F.col("score")).alias("score"))


def candidate_scores(rules: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """rules (keys, rule metrics 0..100) and judgments (keys, dimension, score 1..5) to one row per answer: the metrics, every
    dimension on 0..100, layers that weigh the judge's score of their own dimension in, and overall. Guards are in no layer.

    An answer without a judgment of a layer's dimension has no score there, nor overall.
    """
    at = [F.max(F.when(F.col("dimension") == x, judge_to_100(F.col("score")))).alias(x) for x in DIMENSIONS]
    x = rules.join(judgments.groupBy(*keys).agg(*at), keys)
    named = lambda layer, m: F.col(config.JUDGED_DIMENSIONS[layer] if m == config.JUDGE_METRIC else m)
    x = x.withColumns({layer: rounded(sum((F.lit(w) * named(layer, m) for m, w in ws.items()), F.lit(0.0))) for layer, ws in config.JUDGED_WEIGHTS.items()})
    return x.withColumn("overall", rounded(sum((F.lit(w) * F.col(layer) for layer, w in config.LAYER_WEIGHTS.items()), F.lit(0.0))))


def score_parts() -> dict[str, str]:
    """What candidate_scores gives, by kind."""
    rules = {m: "rule" for ws in config.JUDGED_WEIGHTS.values() for m in ws if m != config.JUDGE_METRIC}
    judged = {x: "judge" if x in config.JUDGED_DIMENSIONS.values() else "guard" for x in DIMENSIONS}
    return rules | judged | {layer: "layer" for layer in config.JUDGED_WEIGHTS} | {"overall": "overall"}


def variant_means(scores: DataFrame) -> DataFrame:
    """candidate_scores with a variant to (kind, part, base, tuned, delta, answers): means are rounded, then their difference."""
    one = [F.struct(F.lit(kind).alias("kind"), F.lit(part).alias("part"), F.col(part).alias("value")) for part, kind in score_parts().items()]
    at = lambda v: rounded(F.avg(F.when(F.col("variant") == v, F.col("value")))).alias(v)
    x = scores.select("variant", F.inline(F.array(*one))).groupBy("kind", "part").agg(at("base"), at("tuned"), F.count("*").alias("answers"))
    return x.withColumn("delta", rounded(F.col("tuned") - F.col("base")))


def unbound(judgments: DataFrame, audit: DataFrame, columns: list[str]) -> DataFrame:
    """Judgments that no successful call backs, by all identifying columns."""
    return judgments.join(audit.where("status = 'ok'").select(*columns), columns, "left_anti")


def altered_key(key: DataFrame, comparisons: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows in which a stored key differs from the one rebuilt from its sources."""
    from .checks import multiset_differs

    return multiset_differs(key, build_requests(comparisons, assignment)[1].select(*key.columns))
