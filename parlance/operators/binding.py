"""Binding recorded comparisons to the frozen turns they claim to answer.

Every supervised assistant turn of the frozen source must have one comparison, with the turn's own fields and seed, and
with prompts that are exactly the history that its mode prescribes. Under gold history that is the source itself. In a rollout it is what
each candidate has said so far: its recorded responses at the turns that were evaluated, the source's words at turns that were not
(bridges), and all system and user turns as they are. Histories are compared as additive digests (functions/digest.py), which prefix
sums give for every turn at once; no history is built, so work is linear in the messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digest as D
from ..functions.text import stable_seed
from .prefix import prefixes

GOLD, ROLLOUT = "controlled_gold_history", "rollout"
VARIANTS = ("base", "tuned")
#: Fields of a comparison that must be those of its turn.
FROZEN = ("record_id", "split", "capability", "scenario_group", "seriousness", "risk_flags", "mode", "assistant_turn_index", "latest_user_message", "gold_response")
KEYS = ["split", "record_id"]


def evaluation_id(split: Column, record: Column, mode: Column, index: Column) -> Column:
    return F.format_string("%s:%s:%s:T%02d", split, record, mode, index)


def numbered(turns: DataFrame, mode: str) -> DataFrame:
    """turns (split, record_id, turn, role, content, policy, ...) with position, assistant_turn_index, latest_user_message, evaluated and eval_id."""
    spoken = F.when(F.col("role") == "assistant", 1).otherwise(0)
    x = prefixes(turns, KEYS, "turn", {"position": F.lit(1), "earlier": spoken}, {"latest_user_message": F.when(F.col("role") == "user", F.col("content"))})
    total = turns.groupBy(*[F.col(k).alias(f"t_{k}") for k in KEYS]).agg(F.sum(spoken).alias("total"))
    x = x.join(total, F.expr("split <=> t_split AND record_id <=> t_record_id")).drop("t_split", "t_record_id")
    x = x.withColumn("assistant_turn_index", F.when(F.col("role") == "assistant", F.col("earlier") + 1))
    wanted = (F.col("role") == "assistant") & ((F.coalesce("policy", F.lit("all")) == "all") | (F.col("assistant_turn_index") == F.col("total")))
    x = x.withColumns({"evaluated": wanted, "mode": F.lit(mode)}).drop("earlier", "total")
    return x.withColumn("eval_id", F.when(F.col("evaluated"), evaluation_id(F.col("split"), F.col("record_id"), F.col("mode"), F.col("assistant_turn_index"))))


Settle = Callable[[DataFrame], DataFrame]


def expected(turns: DataFrame, comparisons: DataFrame, mode: str, root_seed: int, settle: Settle = lambda df: df) -> DataFrame:
    """One row per comparison that must be there: eval_id, the frozen fields, seed, and the digest of each variant's prompt.

    settle: writes a table and reads it again, so that what several branches need is worked out once (sources/scratch.py has one)."""
    if mode not in (GOLD, ROLLOUT):
        raise ValueError(f"unknown mode {mode!r}")
    x = settle(numbered(turns, mode))
    said = {v: F.col("content") for v in VARIANTS}
    if mode == ROLLOUT:
        # of comparisons that are there more than once, which is reported, one is followed
        own = comparisons.groupBy(F.col("eval_id").alias("c_id")).agg(F.min(F.struct(*[F.col(f"{v}_response").alias(v) for v in VARIANTS])).alias("own"))
        x = x.join(own, F.col("eval_id") == F.col("c_id"), "left")
        said = {v: F.when(F.col("evaluated"), F.coalesce(f"own.{v}", "content")).otherwise(F.col("content")) for v in VARIANTS}
    parts = {}
    for v in VARIANTS if mode == ROLLOUT else VARIANTS[:1]:
        parts[f"{v}_a"], parts[f"{v}_b"] = D.halves(D.part_hash(F.col("position"), F.col("role"), said[v]))
    x = prefixes(x, KEYS, "turn", parts).where("evaluated")
    prompt = lambda v: D.rendered(F.col("position"), F.col(f"{v}_a"), F.col(f"{v}_b"))
    return x.withColumnRenamed("content", "gold_response").select(
        "eval_id", *FROZEN, stable_seed(F.lit(str(root_seed)), F.col("split"), F.col("record_id"), F.col("mode"), F.col("assistant_turn_index").cast("string")).alias("seed"),
        *[prompt(v if mode == ROLLOUT else VARIANTS[0]).alias(f"{v}_prompt") for v in VARIANTS],
    )


def turn_violations(turns: DataFrame, comparisons: DataFrame, mode: str, root_seed: int, config: str, settle: Settle = lambda df: df) -> DataFrame:
    """(rule_id, record_id, detail) for what is missing, unexpected, repeated, or differs from its frozen turn.

    comparisons: eval_id, the frozen fields, seed, config_sha256, and per variant <v>_prompt (a digest) and <v>_response; config: the hash that the manifest states."""
    fields = [*FROZEN, "seed", *[f"{v}_prompt" for v in VARIANTS]]
    comparisons = settle(comparisons)
    want = expected(turns, comparisons, mode, root_seed, settle).select(F.col("eval_id").alias("w_id"), *[F.col(f).alias(f"w_{f}") for f in fields])
    x = comparisons.join(want, F.col("eval_id") == F.col("w_id"), "full_outer")
    both = F.col("w_id").isNotNull() & F.col("eval_id").isNotNull()
    tests = [(F.col("eval_id").isNull(), "missing"), (F.col("w_id").isNull(), "unexpected")]
    tests += [(both & ~F.col(f).eqNullSafe(F.col(f"w_{f}")), f) for f in fields]
    tests.append((both & ~F.col("config_sha256").eqNullSafe(F.lit(config)), "config_sha256"))
    found = F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in tests])))
    out = x.select(F.lit("V28").alias("rule_id"), F.coalesce("eval_id", "w_id").alias("record_id"), found.alias("detail"))
    again = comparisons.groupBy("eval_id").agg(F.count("*").alias("n")).where("n > 1")
    return out.unionByName(again.select(F.lit("V28").alias("rule_id"), F.col("eval_id").alias("record_id"), F.lit("repeated").alias("detail")))


def protocol(view: DataFrame, split: str = "test", mode: str = GOLD, capabilities: tuple[str, ...] = (), risks: tuple[str, ...] = ()) -> DataFrame:
    """What a frozen view obliges a review to hold: eval_id, record_id and critical, which one row of a record makes all of its rows.

    view: id, source_record_id, assistant_turn_index, split, labels (array), risk_flags (array). Labels and flags count in any case, with space around."""
    plain = lambda c: F.transform(c, lambda v: F.lower(F.trim(v)))
    any_of = lambda c, values: F.coalesce(F.arrays_overlap(plain(F.coalesce(c, F.array().cast("array<string>"))), F.array(*map(F.lit, values)).cast("array<string>")), F.lit(False))
    own = any_of(F.col("labels"), capabilities) | any_of(F.col("risk_flags"), risks)
    per = view.groupBy(F.col("source_record_id").alias("record_id")).agg(F.max(own).alias("critical"))
    ids = view.select(F.col("source_record_id").alias("record_id"), evaluation_id(F.lit(split), F.col("source_record_id"), F.lit(mode), F.col("assistant_turn_index")).alias("eval_id"))
    return ids.join(per, "record_id").select("eval_id", "record_id", "critical")


def view_violations(view: DataFrame, split: str = "test", declared: int | None = None) -> DataFrame:
    """Rows of a frozen view that can't bear a protocol: of another split, without a record, with a bad index, with an id that is not theirs or not alone."""
    i = F.col("id")
    right = F.concat_ws("::", "source_record_id", F.concat(F.lit("A"), F.col("assistant_turn_index").cast("string")))
    tests = [
        (~F.col("split").eqNullSafe(F.lit(split)), "split"), (F.coalesce(F.col("source_record_id") == "", F.lit(True)), "source_record_id"),
        (F.coalesce(F.col("assistant_turn_index") < 1, F.lit(True)), "assistant_turn_index"), (~i.eqNullSafe(right), "id"),
    ]
    found = F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in tests])))
    out = view.select(F.lit("D7").alias("rule_id"), i.alias("record_id"), found.alias("detail"))
    again = view.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("D7").alias("rule_id"), F.col("id").alias("record_id"), F.lit("repeated").alias("detail"))
    out = out.unionByName(again)
    if declared is not None:
        count = view.agg(F.count("*").alias("n")).where(F.col("n") != declared)
        out = out.unionByName(count.select(F.lit("D7").alias("rule_id"), F.lit("view").alias("record_id"), F.concat(F.lit("rows "), F.col("n").cast("string")).alias("detail")))
    return out


def reconciliation(obliged: DataFrame, comparisons: DataFrame, reviews: DataFrame) -> DataFrame:
    """The protocol, the comparisons and the reviews, three ways at once: (eval_id, detail) for ids that one of them lacks or has more than once, and
    for reviews whose id is not the one that their own fields make.

    obliged: eval_id, critical; comparisons: eval_id; reviews: eval_id, split, record_id, mode, assistant_turn_index. A missing critical row is told apart."""
    sides = [obliged.select("eval_id", F.lit(0).alias("side"), "critical"), comparisons.select("eval_id", F.lit(1).alias("side"), F.lit(None).cast("boolean").alias("critical")), reviews.select("eval_id", F.lit(2).alias("side"), F.lit(None).cast("boolean").alias("critical"))]
    both = sides[0].unionByName(sides[1]).unionByName(sides[2])
    counted = both.groupBy("eval_id").agg(*[F.count_if(F.col("side") == k).alias(n) for k, n in enumerate(("asked", "compared", "reviewed"))], F.max("critical").alias("critical"))
    tests = [
        ((F.col("asked") > 0) & (F.col("compared") == 0), F.lit("no comparison")), ((F.col("asked") == 0) & (F.col("compared") > 0), F.lit("comparison not asked for")),
        ((F.col("asked") > 0) & (F.col("reviewed") == 0), F.when(F.col("critical"), "no review of a critical row").otherwise("no review")),
        ((F.col("asked") == 0) & (F.col("reviewed") > 0), F.lit("review not asked for")), (F.col("compared") > 1, F.lit("compared twice")), (F.col("reviewed") > 1, F.lit("reviewed twice")),
    ]
    out = counted.select("eval_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for c, n in tests]))).alias("detail"))
    right = evaluation_id(F.col("split"), F.col("record_id"), F.col("mode"), F.col("assistant_turn_index"))
    return out.unionByName(reviews.where(~F.col("eval_id").eqNullSafe(right)).select("eval_id", F.concat(F.lit("bound to "), right).alias("detail")))


def completeness(obliged: DataFrame, reviews: DataFrame, found: DataFrame, split: str = "test", mode: str = GOLD) -> DataFrame:
    """One row: what was expected and seen, how many ids fail, and whether the protocol is complete."""
    own = reviews.agg(F.count("*").alias("rows"), F.count_distinct("record_id").alias("records"), F.coalesce(F.every((F.col("split") == split) & (F.col("mode") == mode)), F.lit(False)).alias("one_kind"))
    want = obliged.agg(F.count_distinct("eval_id").alias("expected_rows"), F.count_distinct("record_id").alias("expected_records"), F.count_if("critical").alias("expected_critical"))
    bad = found.agg(F.count("*").alias("failures"))
    x = own.crossJoin(want).crossJoin(bad)  # three single rows
    return x.withColumn("complete", F.col("one_kind") & (F.col("failures") == 0) & (F.col("records") == F.col("expected_records")) & (F.col("expected_critical") > 0))
