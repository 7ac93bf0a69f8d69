"""Queries on conversations, paired reviews, judgments, likelihoods and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import metrics as M
from ..functions import text as X
from ..operators import checks as V
from ..operators import judge as J
from ..operators import review as R
from ..operators import training as T
from ..operators.turns import expand_turns
from ..sources.tables import table
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def turns(spark, d):
    return table(spark, d, "conversations")


BEFORE = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@add("turn_expand_final_only", f"SELECT * FROM (SELECT conv_id, turn, text AS completion, role, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS assistant_turn_index, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS assistant_turn_count FROM conversations) WHERE role = 'assistant' AND assistant_turn_index = assistant_turn_count".replace("SELECT * FROM", "SELECT conv_id, turn, completion, assistant_turn_index::bigint AS assistant_turn_index FROM", 1))
def turn_expand_final_only(spark, d):
    return expand_turns(turns(spark, d), "final_only").select("conv_id", "turn", "completion", "assistant_turn_index")


@add("rollout_history", f"SELECT conv_id, turn, prompt_sha256 FROM (SELECT conv_id, turn, role, sha256(array_to_string(list(said) {BEFORE}, chr(10))) AS prompt_sha256 FROM (SELECT *, '[' || role || '] ' || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'own: ' || text ELSE text END AS said FROM conversations)) WHERE role = 'assistant' AND prompt_sha256 IS NOT NULL")
def rollout_history(spark, d):
    """History of a candidate's own answers: the recorded response where there is one, the reference turn elsewhere."""
    own = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.concat(F.lit("own: "), F.col("text")))
    said = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.coalesce(own, F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    x = turns(spark, d).withColumn("past", F.collect_list(said).over(before)).where("role = 'assistant' AND size(past) > 0")
    return x.select("conv_id", "turn", F.sha2(F.array_join("past", "\n"), 256).alias("prompt_sha256"))


@add("latest_user_message", f"SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) {BEFORE} AS latest FROM conversations")
def latest_user_message(spark, d):
    return T.latest(turns(spark, d)).select("conv_id", "turn", "latest")


@add("transcript_render", "SELECT conv_id, string_agg('[' || upper(role) || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript_render(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("] "), m["text"])), "\n").alias("transcript"))


@add("canonical_message_hash", "SELECT conv_id, turn, sha256(to_json({'content': text, 'role': role})::varchar) AS message_sha256 FROM conversations")
def canonical_message_hash(spark, d):
    return turns(spark, d).select("conv_id", "turn", X.canonical_hash(F.struct(F.col("text").alias("content"), "role")).alias("message_sha256"))


@add("joined_user_text", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user')) AS user_sha256, last(text ORDER BY turn) FILTER (role = 'assistant') AS final_answer FROM conversations GROUP BY conv_id")
def joined_user_text(spark, d):
    """User texts joined by new lines, and the supervised text when only the final answer counts."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    x = turns(spark, d).groupBy("conv_id").agg(rows.alias("m"))
    of = lambda role: F.transform(F.filter("m", lambda m: m["role"] == role), lambda m: m["text"])
    user = of("user")
    return x.select("conv_id", F.when(F.size(user) > 0, F.sha2(F.array_join(user, "\n"), 256)).alias("user_sha256"), F.try_element_at(of("assistant"), F.lit(-1)).alias("final_answer"))


@add("role_order_violations", """WITH s AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, bool_or(turn = 0 AND role = 'system') OVER (PARTITION BY conv_id) AS has FROM conversations),
  c AS (SELECT conv_id, k - has::int AS j, role, text FROM s WHERE NOT (has AND k = 0))
  SELECT 'V3' AS rule_id, conv_id::varchar AS record_id, count(*)::varchar AS detail FROM c GROUP BY conv_id HAVING NOT (count(*) >= 2 AND count(*) % 2 = 0 AND bool_and(role = CASE WHEN j % 2 = 0 THEN 'user' ELSE 'assistant' END) AND bool_and(length(trim(text)) > 0))""")
def role_order_violations(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    x = turns(spark, d).groupBy("conv_id").agg(rows.alias("m"))
    talk = F.size(F.filter("m", lambda m, i: (i > 0) | (m["role"] != "system")))
    return V.violations(x, "V3", F.col("conv_id"), ~V.roles_alternate(F.col("m")), talk)


@add("patch_messages", "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND conv_id % 10 = 3 AND turn = 1 THEN 'patched ' || conv_id::varchar ELSE text END AS text FROM conversations")
def patch_messages(spark, d):
    """Corrections addressed by (record, turn), applied to assistant turns only: a left join that leaves other rows alone."""
    patches = turns(spark, d).where("conv_id % 10 = 3 AND turn = 1").select("conv_id", "turn", F.concat(F.lit("patched "), F.col("conv_id").cast("string")).alias("new"))
    x = turns(spark, d).join(patches, ["conv_id", "turn"], "left")
    return x.select("conv_id", "turn", F.when(F.col("role") == "assistant", F.coalesce("new", "text")).otherwise(F.col("text")).alias("text"))


# ---- paired reviews, made from labels: two scores a document, swapped by a hash of its id
PAIRS = """(SELECT l.doc_id AS eval_id, d.lang, sha256(l.doc_id::varchar)[1:1] < '8' AS swapped, l.doc_id % 5 + 1 AS a_score, l.doc_id // 5 % 5 + 1 AS b_score,
  l.toxic = 1 AND l.doc_id % 2 = 0 AS a_critical, l.toxic = 1 AND l.doc_id % 3 = 0 AS b_critical, CASE l.doc_id % 3 WHEN 0 THEN ' A' WHEN 1 THEN 'b' ELSE 'Tie' END AS preference FROM labels l JOIN documents d USING (doc_id))"""
LONG = f"""(SELECT eval_id, lang, 'a' AS side, CASE WHEN swapped THEN 'tuned' ELSE 'base' END AS variant, a_score AS score, a_critical AS critical FROM {PAIRS}
  UNION ALL SELECT eval_id, lang, 'b', CASE WHEN swapped THEN 'base' ELSE 'tuned' END, b_score, b_critical FROM {PAIRS})"""


def pairs(spark, d):
    i = F.col("doc_id")
    own = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    pref = F.when(F.pmod(i, F.lit(3)) == 0, " A").when(F.pmod(i, F.lit(3)) == 1, "b").otherwise("Tie")
    return own.select(
        i.alias("eval_id"), "lang", (F.substring(F.sha2(i.cast("string"), 256), 1, 1) < "8").alias("swapped"),
        (F.pmod(i, F.lit(5)) + 1).alias("a_score"), (F.pmod(F.floor(i / 5), F.lit(5)) + 1).alias("b_score"),
        ((F.col("toxic") == 1) & (F.pmod(i, F.lit(2)) == 0)).alias("a_critical"), ((F.col("toxic") == 1) & (F.pmod(i, F.lit(3)) == 0)).alias("b_critical"), pref.alias("preference"),
    )


def long(spark, d):
    p = pairs(spark, d)
    return R.sides(p).join(p.select("eval_id", "lang"), "eval_id")


@add("blind_ab_assignment", f"SELECT eval_id, CASE WHEN swapped THEN 'tuned' ELSE 'base' END AS a_variant, CASE WHEN swapped THEN 'base' ELSE 'tuned' END AS b_variant FROM {PAIRS}")
def blind_ab_assignment(spark, d):
    x = R.sides(pairs(spark, d))
    return x.groupBy("eval_id").agg(F.max(F.when(F.col("side") == "a", F.col("variant"))).alias("a_variant"), F.max(F.when(F.col("side") == "b", F.col("variant"))).alias("b_variant"))


@add("seeded_review_sheet", None)
def seeded_review_sheet(spark, d):
    """The Mersenne-Twister order and swaps of a review sheet; the ids of one sheet are its conversations'."""
    ids = [str(r.conv_id) for r in turns(spark, d).select("conv_id").distinct().collect()]
    return R.seeded_assignment(spark, ids, seed=42)


@add("unblind_scores", f"SELECT eval_id, side, variant, score::bigint AS score, critical FROM {LONG}")
def unblind_scores(spark, d):
    return R.sides(pairs(spark, d)).withColumn("score", F.col("score").cast("long"))


@add("score_means_grouping_sets", f"SELECT variant, lang, round(avg(score) + 1e-9::double, 4) AS mean, count(*)::bigint AS n FROM {LONG} GROUP BY GROUPING SETS ((variant), (variant, lang))")
def score_means_grouping_sets(spark, d):
    long(spark, d).createOrReplaceTempView("parlance_long")
    return spark.sql("SELECT variant, lang, round(avg(score) + 1e-9D, 4) AS mean, count(*) AS n FROM parlance_long GROUP BY GROUPING SETS ((variant), (variant, lang))")


WON = f"(SELECT lang, CASE WHEN lower(trim(preference)) = 'tie' THEN 'tie' WHEN lower(trim(preference)) = CASE WHEN swapped THEN 'b' ELSE 'a' END THEN 'base' ELSE 'tuned' END AS winner FROM {PAIRS})"


@add("win_tie_loss", f"SELECT lang, sum((winner = 'tuned')::int)::bigint AS wins, sum((winner = 'base')::int)::bigint AS losses, sum((winner = 'tie')::int)::bigint AS ties, round(sum((winner = 'tuned')::int)::double / nullif(sum((winner <> 'tie')::int), 0) + 1e-9::double, 4) AS decisive_rate FROM {WON} GROUP BY lang")
def win_tie_loss(spark, d):
    p = pairs(spark, d)
    return R.win_tie_loss(R.preferred(p).join(p.select("eval_id", "lang"), "eval_id"), "lang")


@add("safety_gate", f"SELECT variant, count(*)::bigint AS n, sum((critical OR score < 4)::int)::bigint AS failures, sum((critical OR score < 4)::int) = 0 AS passes FROM {LONG} GROUP BY variant")
def safety_gate(spark, d):
    return R.safety_gate(long(spark, d))


@add("new_critical_failures", f"SELECT b.eval_id FROM {LONG} b JOIN {LONG} t USING (eval_id) WHERE b.variant = 'base' AND t.variant = 'tuned' AND NOT b.critical AND t.critical")
def new_critical_failures(spark, d):
    at = lambda v: F.max(F.when(F.col("variant") == v, F.col("critical")))
    return long(spark, d).groupBy("eval_id").agg(at("base").alias("b"), at("tuned").alias("t")).where("NOT b AND t").select("eval_id")


@add("variant_delta", f"SELECT lang, base, tuned, round(tuned - base + 1e-9::double, 4) AS delta FROM (SELECT lang, round(avg(score) FILTER (variant = 'base') + 1e-9::double, 4) AS base, round(avg(score) FILTER (variant = 'tuned') + 1e-9::double, 4) AS tuned FROM {LONG} GROUP BY lang)")
def variant_delta(spark, d):
    return R.deltas(long(spark, d), "lang")


@add("judge_to_100", "SELECT doc_id, (doc_id % 5) * 25.0::double AS score FROM labels")
def judge_to_100(spark, d):
    return table(spark, d, "labels").select("doc_id", M.judge_to_100(F.pmod("doc_id", F.lit(5)) + 1).cast("double").alias("score"))


@add("evidence_verbatim", "SELECT d.doc_id, length(trim(substring(p.text, 1, 4))) > 0 AND contains(d.text, substring(p.text, 1, 4)) AND contains(d.text, 'tion') AS verbatim FROM documents d JOIN documents p ON d.doc_id = p.doc_id + 1")
def evidence_verbatim(spark, d):
    """Every quoted evidence must stand in the response word for word: here the beginning of another document, and a fixed one."""
    own = table(spark, d, "documents").select("doc_id", "text")
    quotes = own.select((F.col("doc_id") + 1).alias("doc_id"), F.substring("text", 1, 4).alias("quote"))
    return own.join(quotes, "doc_id").select("doc_id", J.quoted(F.array("quote", F.lit("tion")), F.col("text")).alias("verbatim"))


@add("label_function", f"SELECT variant, count(DISTINCT side)::bigint AS labels FROM {LONG} GROUP BY variant HAVING count(DISTINCT side) > 1")
def label_function(spark, d):
    return long(spark, d).groupBy("variant").agg(F.count_distinct("side").alias("labels")).where("labels > 1")


# ---- likelihoods: a record per document, tokens and sums from its length and id
NLL = f"(SELECT d.source AS source_record_id, CASE d.lang {' '.join(f'WHEN {S.q(k)} THEN {S.q(v)}' for k, v in config.CAPABILITIES.items())} END || (ascii(right(d.source, 1)) % 2)::varchar AS capability, d.n_chars // 4 + 1 AS supervised_tokens, (d.n_chars // 4 + 1) * (2.0::double + (d.doc_id % 13) / 10.0::double) AS nll_sum FROM documents d)"


def nll(spark, d):
    tokens = F.floor(F.col("n_chars") / 4) + 1
    cap = F.concat(X.mapped(F.col("lang"), config.CAPABILITIES), (F.ascii(F.right("source", F.lit(1))) % 2).cast("string"))
    return table(spark, d, "documents").select(F.col("source").alias("source_record_id"), cap.alias("capability"), tokens.alias("supervised_tokens"), (tokens * (2.0 + F.pmod("doc_id", F.lit(13)) / 10.0)).alias("nll_sum"))


@add("macro_nll", f"SELECT round(avg(nll), 6) AS macro_nll, sum(records)::bigint AS records FROM (SELECT capability, avg(nll) AS nll, count(*) AS records FROM (SELECT source_record_id, capability, sum(nll_sum) / sum(supervised_tokens) AS nll FROM {NLL} GROUP BY 1, 2) GROUP BY 1)")
def macro_nll(spark, d):
    return T.macro_nll(nll(spark, d))


@add("micro_nll", f"SELECT round(sum(nll_sum) / sum(supervised_tokens), 6) AS micro_nll FROM {NLL}")
def micro_nll(spark, d):
    return T.micro_nll(nll(spark, d))


@add("metric_recompute", f"WITH c AS (SELECT capability, sum(nll_sum) / sum(supervised_tokens) AS v FROM {NLL} GROUP BY 1) SELECT capability FROM (SELECT capability, CASE WHEN capability LIKE 'd%' THEN v * 1.001 ELSE v END AS declared, v FROM c) WHERE abs(declared - v) > 1e-9 * greatest(abs(declared), abs(v))")
def metric_recompute(spark, d):
    c = nll(spark, d).groupBy("capability").agg((F.sum("nll_sum") / F.sum("supervised_tokens")).alias("v"))
    told = c.withColumn("v", F.when(F.col("capability").startswith("d"), F.col("v") * 1.001).otherwise(F.col("v")))
    return T.metric_mismatch(told, c, "capability", "v").select("capability")


STEPS = "(SELECT doc_id % 5 * 26 + 26 AS step, round(avg(n_chars), 2) AS metric FROM documents GROUP BY 1)"


@add("checkpoint_select", f"SELECT min(step)::bigint AS step FROM {STEPS}, (SELECT min(metric) AS best FROM {STEPS}) WHERE abs(metric - best) <= abs(best) * 0.05")
def checkpoint_select(spark, d):
    steps = table(spark, d, "documents").groupBy((F.pmod("doc_id", F.lit(5)) * 26 + 26).alias("step")).agg(F.round(F.avg("n_chars"), 2).alias("metric"))
    return R.tolerant_argmin(steps, "metric", "step", 0.05).select("step")


@add("selection_status", "SELECT CASE WHEN list_sort(list(DISTINCT step)) <> [26, 52, 78, 104, 130] THEN 'incomplete' WHEN NOT bool_and(intact) THEN 'failed_integrity' WHEN sum(safe::int) = 0 THEN 'failed_no_safe_checkpoint' ELSE 'selected' END AS status, sum(safe::int)::bigint AS safe FROM (SELECT doc_id % 5 * 26 + 26 AS step, bool_and(n_chars > 0) AS intact, min(n_chars) > 1000 AS safe FROM documents GROUP BY 1)")
def selection_status(spark, d):
    c = table(spark, d, "documents").groupBy((F.pmod("doc_id", F.lit(5)) * 26 + 26).alias("step")).agg(F.every(F.col("n_chars") > 0).alias("intact"), (F.min("n_chars") > 1000).alias("safe"))
    return T.selection_status(c, T.expected_steps(103, 2, 2, 5))


LOG = "(SELECT event_id AS step, user_id::double / 10 AS epoch, CASE WHEN event_type <> 'view' THEN value END AS loss, CASE WHEN event_type IN ('view', 'click') THEN value * 2 END AS eval_loss FROM events)"
POINTS = f"(SELECT step, epoch, unnest(['loss', 'eval_loss']) AS series, unnest([loss, eval_loss]) AS value FROM {LOG})"


def log(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").select(F.col("event_id").alias("step"), (F.col("user_id") / 10.0).alias("epoch"), F.when(e != "view", F.col("value")).alias("loss"), F.when(e.isin("view", "click"), F.col("value") * 2).alias("eval_loss"))


@add("log_points_unpivot", f"SELECT series, step, epoch, value FROM {POINTS} WHERE value IS NOT NULL")
def log_points_unpivot(spark, d):
    return T.log_points(log(spark, d), ["loss", "eval_loss"]).select("series", "step", "epoch", "value")


@add("log_minmax_scale", f"WITH p AS (SELECT * FROM {POINTS} WHERE value IS NOT NULL), e AS (SELECT min(value) AS low, max(value) AS high, min(step) AS f, max(step) AS l, greatest((max(value) - min(value)) * 0.08::double, 0.01::double) AS pad FROM p) SELECT series, step, round((step - f)::double / (l - f), 6) AS x, round((value - low + pad) / (high - low + 2 * pad), 6) AS y FROM p, e")
def log_minmax_scale(spark, d):
    return T.plot_points(T.log_points(log(spark, d), ["loss", "eval_loss"]))


METRIC = "(SELECT event_id, CASE event_id % 101 WHEN 0 THEN 'nan'::double WHEN 1 THEN 'inf'::double WHEN 2 THEN '-inf'::double WHEN 3 THEN NULL ELSE value END AS value FROM events)"


@add("finite_metrics", f"SELECT event_id FROM {METRIC} WHERE value IS NULL OR isnan(value) OR isinf(value)")
def finite_metrics(spark, d):
    """Metrics that are no finite number; some are planted."""
    k, v = F.pmod("event_id", F.lit(101)), F.col("value")
    planted = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k != 3, v)
    return table(spark, d, "events").withColumn("value", planted).where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).select("event_id")


@add("single_fingerprint", "SELECT user_id, count(DISTINCT event_type)::bigint AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) <> 1")
def single_fingerprint(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).where("kinds <> 1")


@add("audit_binding", "SELECT a.event_id FROM events a WHERE a.event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND b.user_id = a.user_id AND b.props = a.props)")
def audit_binding(spark, d):
    """Results that a successful call backs, by all identifying columns."""
    e = table(spark, d, "events")
    return e.where("event_type = 'view'").join(e.where("event_type = 'click'").select("user_id", "props"), ["user_id", "props"], "left_semi").select("event_id")


@add("pending_requests", "SELECT event_id FROM events WHERE event_type = 'signup' AND event_id NOT IN (SELECT doc_id FROM labels)")
def pending_requests(spark, d):
    return table(spark, d, "events").where("event_type = 'signup'").select("event_id").join(table(spark, d, "labels").select(F.col("doc_id").alias("event_id")), "event_id", "left_anti")


@add("ext_tumbling_events", "SELECT date_trunc('day', ts)::timestamp AS day, event_type, count(*)::bigint AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2".replace("date_trunc('day', ts)::timestamp AS day", "strftime(ts, '%Y-%m-%d') AS day"))
def ext_tumbling_events(spark, d):
    """Extension: daily windows over event time."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
