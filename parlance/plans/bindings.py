"""Queries that bind recorded comparisons and reviews to frozen turns; the records are planted with a fault of each kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import binding as B
from ..sources.scratch import settled
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SEED, STATED = 20240, "c" * 64
CAPABILITIES = list(config.CAPABILITIES.values())


def add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


def frozen(spark, d):
    """conversations as frozen turns: every third record is evaluated at its last turn only."""
    i = F.col("conv_id")
    k = F.pmod(i, F.lit(5))
    return table(spark, d, "conversations").select(
        F.when(k == 3, "validation").when(k == 4, "test").otherwise("train").alias("split"), i.cast("string").alias("record_id"), i.alias("number"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"),
        F.when(F.pmod(i, F.lit(3)) == 0, "final_only").otherwise("all").alias("policy"), F.element_at(F.array(*map(F.lit, CAPABILITIES)), (F.pmod(i, F.lit(4)) + 1).cast("int")).alias("capability"),
        F.concat(F.lit("g"), F.floor(i / 3).cast("string")).alias("scenario_group"), (k + 1).cast("int").alias("seriousness"),
        F.when(F.pmod(i, F.lit(6)) == 0, F.array(F.lit(" Harm_Request"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"),
    )


def recorded(spark, d, mode):
    """Comparisons as an honest generator records them, then a fault of one kind in every thirty-first record."""
    turns = frozen(spark, d)
    answers = B.numbered(turns, mode).where("evaluated").select("eval_id", F.concat(F.lit("b:"), "eval_id").alias("base_response"), F.concat(F.lit("t:"), "eval_id").alias("tuned_response"))
    x = B.expected(turns, answers, mode, SEED, settled).join(answers, "eval_id").withColumn("config_sha256", F.lit(STATED))
    k, first = F.pmod(F.col("record_id").cast("long"), F.lit(31)), F.col("assistant_turn_index") == 1
    copies = F.when((k == 1) & first, F.array().cast("array<string>")).when((k == 2) & first, F.array(F.lit(""), F.lit("X"))).when((k == 3) & first, F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.lit("")))
    x = x.withColumn("mark", F.explode(copies)).withColumn("eval_id", F.concat("eval_id", "mark")).drop("mark").withColumn("k", k)
    set_ = lambda n, value, column: F.when(F.col("k") == n, value).otherwise(F.col(column))
    return x.withColumns({
        "latest_user_message": set_(4, F.concat("latest_user_message", F.lit("!")), "latest_user_message"), "gold_response": set_(5, F.concat("gold_response", F.lit("!")), "gold_response"),
        "seed": set_(6, F.col("seed") + 1, "seed"), "config_sha256": set_(7, F.lit("other"), "config_sha256"), "base_prompt": set_(8, F.col("tuned_prompt"), "base_prompt"), "tuned_prompt": set_(9, F.lit("0:0:0"), "tuned_prompt"),
        "capability": set_(10, F.lit("other"), "capability"), "assistant_turn_index": set_(11, F.col("assistant_turn_index") + 1, "assistant_turn_index"), "risk_flags": set_(12, F.lit(None), "risk_flags"),
        "base_response": set_(13, F.concat("base_response", F.lit("!")), "base_response"),
    }).drop("k")


BEFORE = "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _turns_sql(mode: str) -> str:
    """Common tables p (frozen turns, numbered) and e (evaluated ones, with what was recorded and what must have been)."""
    word = lambda text, at: f"('0x' || substr(sha256(pos::varchar || chr(0) || role || chr(0) || {text}), {at}, 15))::bigint"
    said = {"base": "'b:' || eval_id", "tuned": "'t:' || eval_id"} if mode == B.ROLLOUT else {"base": "text", "tuned": "text"}
    after = {"base": "'b:' || eval_id || CASE WHEN k = 13 THEN '!' ELSE '' END", "tuned": "'t:' || eval_id"} if mode == B.ROLLOUT else said
    lost = "k = 1 AND idx = 1"
    prompts = []
    for v in B.VARIANTS:
        own = f"CASE WHEN ev THEN {said[v]} ELSE text END"
        real = f"CASE WHEN ev AND NOT ({lost}) THEN {after[v]} ELSE text END"
        for name, text in (("told", own), ("must", real)):
            prompts.append(f"pos::varchar || ':' || coalesce(sum({word(text, 1)}) OVER {BEFORE}, 0)::varchar || ':' || coalesce(sum({word(text, 16)}) OVER {BEFORE}, 0)::varchar AS {name}_{v}")
    split = "CASE conv_id % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END"
    capability = "[" + ", ".join(f"'{c}'" for c in CAPABILITIES) + "][(conv_id % 4 + 1)::int]"
    return f"""n AS (SELECT *, {split} AS split, {capability} AS capability, conv_id % 31 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, sum((role = 'assistant')::int) OVER (PARTITION BY conv_id ORDER BY turn) AS idx,
        sum((role = 'assistant')::int) OVER (PARTITION BY conv_id) AS total, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER {BEFORE} AS latest FROM conversations),
      p AS (SELECT *, role = 'assistant' AND (conv_id % 3 <> 0 OR idx = total) AS ev, split || ':' || conv_id::varchar || ':{mode}:T' || CASE WHEN idx < 10 THEN '0' ELSE '' END || idx::varchar AS eval_id FROM n),
      h AS (SELECT *, {', '.join(prompts)} FROM p),
      e AS (SELECT *, ('0x' || substr(sha256('{SEED}' || chr(0) || split || chr(0) || conv_id::varchar || chr(0) || '{mode}' || chr(0) || idx::varchar), 1, 8))::bigint AS seed FROM h WHERE ev)"""


def _violations_sql(mode: str) -> str:
    mark = "unnest(CASE WHEN k = 1 AND idx = 1 THEN [] WHEN k = 2 AND idx = 1 THEN ['', 'X'] WHEN k = 3 AND idx = 1 THEN ['', ''] ELSE [''] END)"
    tests = [
        ("c.eval_id IS NULL", "missing"), ("e.eval_id IS NULL", "unexpected"), ("b AND c.k = 10", "capability"), ("b AND c.k = 11", "assistant_turn_index"), ("b AND c.k = 4 AND e.latest IS NOT NULL", "latest_user_message"), ("b AND c.k = 5", "gold_response"),
        ("b AND c.k = 12", "risk_flags"), ("b AND c.k = 6", "seed"), ("b AND c.k = 7", "config_sha256"), ("b AND CASE WHEN c.k = 8 THEN c.told_tuned ELSE c.told_base END <> e.must_base", "base_prompt"), ("b AND (c.k = 9 OR c.told_tuned <> e.must_tuned)", "tuned_prompt"),
    ]
    cases = ", ".join(f"CASE WHEN {c.replace('b AND', 'c.eval_id IS NOT NULL AND e.eval_id IS NOT NULL AND')} THEN '{name}' END" for c, name in tests)
    return f"""WITH {_turns_sql(mode)}, c AS (SELECT * REPLACE (eval_id || mark AS eval_id) FROM (SELECT *, {mark} AS mark FROM e)),
      f AS (SELECT coalesce(c.eval_id, e.eval_id) AS record_id, unnest([{cases}]) AS detail FROM c FULL JOIN e ON c.eval_id = e.eval_id)
      SELECT '{mode}' AS mode, 'V28' AS rule_id, record_id, detail FROM f WHERE detail IS NOT NULL UNION ALL SELECT '{mode}', 'V28', eval_id, 'repeated' FROM c GROUP BY eval_id HAVING count(*) > 1"""


@add("frozen_turn_violations", " UNION ALL ".join(f"(SELECT * FROM ({_violations_sql(m)}))" for m in (B.GOLD, B.ROLLOUT)))
def frozen_turn_violations(spark, d):
    """Recorded comparisons of both modes against the turns they claim to answer."""
    turns = frozen(spark, d)
    parts = [B.turn_violations(turns, recorded(spark, d, m), m, SEED, STATED, settled).select(F.lit(m).alias("mode"), "rule_id", "record_id", "detail") for m in (B.GOLD, B.ROLLOUT)]
    return parts[0].unionByName(parts[1])


# ---- the protocol of a review: every supervised turn of the frozen view, critical ones apart
CRITICAL, RISKS = ("safety",), ("harm_request",)


def view(spark, d):
    """The frozen view of all splits as one: a row for each supervised turn."""
    x = B.numbered(frozen(spark, d), B.GOLD).where("evaluated")
    label = F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" "), F.upper("capability"))).otherwise("plain")  # a label of single turns makes whole records critical
    return settled(x.select(F.concat_ws("::", "record_id", F.concat(F.lit("A"), F.col("assistant_turn_index").cast("string"))).alias("id"), F.col("record_id").alias("source_record_id"), "assistant_turn_index", F.lit("test").alias("split"), F.array(label).alias("labels"), "risk_flags"))


def sheet(frozen_view):
    """Comparisons and reviews of the view; every thirty-seventh record has a fault."""
    own = frozen_view.select(F.col("source_record_id").alias("record_id"), "assistant_turn_index", B.evaluation_id(F.lit("test"), F.col("source_record_id"), F.lit(B.GOLD), F.col("assistant_turn_index")).alias("eval_id"))
    own = own.withColumns({"k": F.pmod(F.col("record_id").cast("long"), F.lit(37)), "first": F.col("assistant_turn_index") == 1, "split": F.lit("test"), "mode": F.lit(B.GOLD)})
    times = lambda gone, twice: F.explode(F.when(F.col("first") & (F.col("k") == gone), F.array().cast("array<int>")).when(F.col("first") & (F.col("k") == twice), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    other = lambda n: F.when(F.col("first") & (F.col("k") == n), F.concat("eval_id", F.lit("X"))).otherwise(F.col("eval_id"))
    compared = own.withColumn("copy", times(1, 2)).select(other(3).alias("eval_id"))
    reviewed = own.withColumn("copy", times(4, 5)).withColumn("assistant_turn_index", F.when(F.col("first") & (F.col("k") == 7), F.lit(9)).otherwise(F.col("assistant_turn_index")))
    return compared, reviewed.select(other(6).alias("eval_id"), "split", "record_id", "mode", "assistant_turn_index")


_VIEW = f"""{_turns_sql(B.GOLD)}, v AS (SELECT conv_id::varchar AS record_id, idx, conv_id % 37 AS k, 'test:' || conv_id::varchar || ':{B.GOLD}:T' || CASE WHEN idx < 10 THEN '0' ELSE '' END || idx::varchar AS eval_id,
    bool_or((turn % 4 = 1 AND capability = 'safety') OR conv_id % 6 = 0) OVER (PARTITION BY conv_id) AS critical FROM e)"""


def _copies(gone: int, twice: int, other: int) -> str:
    return f"SELECT *, CASE WHEN idx = 1 AND k = {other} THEN eval_id || 'X' ELSE eval_id END AS id, unnest(CASE WHEN idx = 1 AND k = {gone} THEN [] WHEN idx = 1 AND k = {twice} THEN [1, 2] ELSE [1] END) AS copy FROM v"


_FOUND = f"""{_VIEW}, c AS ({_copies(1, 2, 3)}), r AS ({_copies(4, 5, 6)}),
    ids AS (SELECT eval_id AS id, 0 AS side, critical FROM v UNION ALL SELECT id, 1, NULL FROM c UNION ALL SELECT id, 2, NULL FROM r),
    g AS (SELECT id, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b, count(*) FILTER (side = 2) AS s, bool_or(critical) AS critical FROM ids GROUP BY id),
    found AS (SELECT id AS eval_id, unnest([CASE WHEN a > 0 AND b = 0 THEN 'no comparison' END, CASE WHEN a = 0 AND b > 0 THEN 'comparison not asked for' END, CASE WHEN a > 0 AND s = 0 THEN CASE WHEN critical THEN 'no review of a critical row' ELSE 'no review' END END,
      CASE WHEN a = 0 AND s > 0 THEN 'review not asked for' END, CASE WHEN b > 1 THEN 'compared twice' END, CASE WHEN s > 1 THEN 'reviewed twice' END]) AS detail FROM g
      UNION ALL SELECT id, 'bound to ' || CASE WHEN k = 7 THEN left(eval_id, length(eval_id) - 3) || 'T09' ELSE eval_id END FROM r WHERE idx = 1 AND k IN (6, 7))"""


@add("protocol_reconciliation", f"WITH {_FOUND} SELECT eval_id, detail FROM found WHERE detail IS NOT NULL")
def protocol_reconciliation(spark, d):
    """The frozen view, the comparisons and the reviews: what one of them lacks, has twice or binds to another turn."""
    own = view(spark, d)
    return B.reconciliation(B.protocol(own, capabilities=CRITICAL, risks=RISKS), *sheet(own))


@add("protocol_completeness", f"""WITH {_FOUND}, w AS (SELECT count(*) AS failures FROM found WHERE detail IS NOT NULL), o AS (SELECT count(*) AS "rows", count(DISTINCT record_id) AS records FROM r), q AS (SELECT count(DISTINCT eval_id) AS expected_rows, count(DISTINCT record_id) AS expected_records, count(*) FILTER (critical) AS expected_critical FROM v)
  SELECT "rows"::bigint AS "rows", records::bigint AS records, true AS one_kind, expected_rows::bigint AS expected_rows, expected_records::bigint AS expected_records, expected_critical::bigint AS expected_critical, failures::bigint AS failures, failures = 0 AND records = expected_records AND expected_critical > 0 AS complete FROM o, q, w""")
def protocol_completeness(spark, d):
    """Counts of the protocol, and whether a review over it is complete."""
    own = view(spark, d)
    obliged = B.protocol(own, capabilities=CRITICAL, risks=RISKS)
    compared, reviewed = sheet(own)
    return B.completeness(obliged, reviewed, B.reconciliation(obliged, compared, reviewed))
