"""Queries on record rules, imports, judgments and the five-dimension review; faults are planted by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import checks as V
from ..operators import judge as J
from ..operators import records as E
from ..operators import review as R
from ..sources.tables import table
from . import relations, texts
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
SYSTEM = "You answer in the voice of the record."


def add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


def case(of: str, table_: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in table_.items()) + f" ELSE {other} END"


# ---- curated records: identity from the document's number, with faults in fixed shares of the ids
GROUP = "'G' || lpad((doc_id % 10 + 1)::varchar, 2, '0')"
RECORDS = f"""(SELECT CASE WHEN doc_id % 53 = 0 THEN 'EN-G01-v9' ELSE upper(lang) || '-' || {GROUP} || '-v' || (doc_id % 3 + 1)::varchar END AS id, upper(lang) || '-' || {GROUP} AS group_id, doc_id % 3 + 1 AS variant,
  CASE WHEN doc_id % 31 = 0 THEN 'daily' ELSE {case('upper(lang)', config.CODES)} END AS capability, CASE WHEN doc_id % 37 = 0 THEN 'test' ELSE {case(GROUP, config.GROUP_SPLITS, "'train'")} END AS split,
  CASE WHEN doc_id % 41 = 0 THEN 'other' WHEN doc_id % 43 = 0 THEN NULL ELSE {S.q(SYSTEM)} END AS system, CASE WHEN doc_id % 10 >= 8 AND doc_id % 7 <> 0 OR doc_id % 47 = 0 THEN 'note' WHEN doc_id % 3 = 0 THEN ' ' END AS conflict FROM documents)"""


def curated(spark, d):
    i, code = F.col("doc_id"), F.upper("lang")
    every = lambda n: F.pmod(i, F.lit(n)) == 0
    group = F.concat(F.lit("G"), F.lpad((F.pmod(i, F.lit(10)) + 1).cast("string"), 2, "0"))
    variant = F.pmod(i, F.lit(3)) + 1
    gid = F.concat(code, F.lit("-"), group)
    return table(spark, d, "documents").select(
        F.when(every(53), "EN-G01-v9").otherwise(F.concat(gid, F.lit("-v"), variant.cast("string"))).alias("id"), gid.alias("group_id"), variant.alias("variant"),
        F.when(every(31), "daily").otherwise(E.mapped(code, config.CODES)).alias("capability"), F.when(every(37), "test").otherwise(F.coalesce(E.mapped(group, config.GROUP_SPLITS), F.lit("train"))).alias("split"),
        F.when(every(41), "other").when(~every(43), SYSTEM).alias("system"),
        F.when(((F.pmod(i, F.lit(10)) >= 8) & ~every(7)) | every(47), "note").when(every(3), " ").alias("conflict"),
    )


NEEDS = f"regexp_extract(id, {S.q(E.RECORD_ID)}, 2) IN ({', '.join(map(S.q, config.CONFLICT_GROUPS))})"


@add("identity_violations", f"""SELECT 'V4' AS rule_id, id AS record_id, 'system' AS detail FROM {RECORDS} WHERE system IS DISTINCT FROM {S.q(SYSTEM)}
  UNION ALL SELECT 'V6', id, group_id || '-v' || variant::varchar FROM {RECORDS} WHERE id <> group_id || '-v' || variant::varchar
  UNION ALL SELECT 'V7', id, capability FROM {RECORDS} WHERE {case(f"regexp_extract(id, {S.q(E.RECORD_ID)}, 1)", config.CODES)} IS DISTINCT FROM capability
  UNION ALL SELECT 'V7', id, split FROM {RECORDS} WHERE {case(f"regexp_extract(id, {S.q(E.RECORD_ID)}, 2)", config.GROUP_SPLITS, "'train'")} IS DISTINCT FROM split
  UNION ALL SELECT 'V8', id, regexp_extract(id, {S.q(E.RECORD_ID)}, 2) FROM {RECORDS} WHERE {NEEDS} <> (length(trim(coalesce(conflict, ''))) > 0)""")
def identity_violations(spark, d):
    return E.identity_violations(curated(spark, d), SYSTEM)


@add("import_projection", f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'imported' ELSE 'curated' END AS source_kind,
  'set' || (conv_id % 3)::varchar || ':' || turn::varchar || ':' || sha256(text) AS provenance, CASE WHEN role = 'system' AND turn = 0 THEN {S.q(SYSTEM)} ELSE text END AS content,
  CASE WHEN conv_id % 5 = 4 THEN NULL WHEN conv_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS mode, text || chr(10) || role || chr(10) || 'f1' || chr(10) || 'f2' AS activation,
  CASE conv_id % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 4.5 WHEN 2 THEN 3.0 ELSE 1.0 END::double AS seriousness FROM conversations""")
def import_projection(spark, d):
    """What an import keeps and adds: kind and provenance of the source, the standard system text, mode, activation text, seriousness."""
    i = F.col("conv_id")
    k = lambda n: F.pmod(i, F.lit(n))
    x = table(spark, d, "conversations").withColumn("_note", F.lit("dropped"))
    alias = F.when(k(5) == 4, "unheard").when(k(2) == 0, " Base").otherwise("LoRA ")
    told = F.when(k(4) == 0, "serious").when(k(4) == 1, "4.5").when(k(4) == 3, "1")
    one = E.with_system(F.array(F.struct("role", F.col("text").alias("content"))), SYSTEM)[0]["content"]
    provenance = F.struct(F.concat(F.lit("set"), k(3).cast("string")).alias("dataset"), F.col("turn").cast("string").alias("line"), F.sha2("text", 256).alias("sha256"))
    return E.without_annotations(x).select(
        "conv_id", "turn", E.source_kind(F.when(k(3) == 0, "set0").otherwise(" ")).alias("source_kind"), F.concat_ws(":", provenance["dataset"], provenance["line"], provenance["sha256"]).alias("provenance"),
        F.when(F.col("turn") == 0, one).otherwise(F.col("text")).alias("content"), E.mode_of(alias).alias("mode"),
        E.activation_text(F.col("text"), F.col("role"), F.array(F.lit("f1"), F.lit("f2"))).alias("activation"), E.seriousness(told).alias("seriousness"),
    )


# ---- judgments on two answers a labelled document, with one kind of fault in each seventh of the ids
DIMS = ", ".join(f"({i}, {S.q(x)})" for i, x in enumerate(J.DIMENSIONS))
JUDGED = f"""(SELECT doc_id, side, n, dimension, CASE WHEN side = 'a' THEN text ELSE 'b: ' || text END AS response, CASE WHEN doc_id % 7 = 4 AND n = 1 THEN 6 ELSE (doc_id + n) % 5 + 1 END AS score,
  CASE WHEN doc_id % 7 = 1 AND n = 0 THEN 'none' WHEN doc_id % 7 = 2 AND n = 2 THEN 'blank' WHEN doc_id % 7 = 5 AND n = 3 THEN 'foreign' ELSE 'ok' END AS kind
  FROM labels JOIN documents USING (doc_id), (VALUES ('a'), ('b')) s(side), (VALUES {DIMS}) v(n, dimension) WHERE NOT (doc_id % 7 = 3 AND side = 'b') AND doc_id % 7 <> 6)"""


def judged(spark, d):
    """(filled requests, judgments)"""
    i = F.col("doc_id")
    k = F.pmod(i, F.lit(7))
    own = table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    filled = own.select(i.cast("string").alias("request_id"), F.col("text").alias("response_a"), F.concat(F.lit("b: "), "text").alias("response_b"))
    x = own.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).select("doc_id", "text", "side", F.posexplode(F.array(*map(F.lit, J.DIMENSIONS))).alias("n", "dimension"))
    x = x.where(~((k == 3) & (F.col("side") == "b")) & (k != 6))
    n = F.col("n")
    some = F.when((k == 1) & (n == 0), F.array().cast("array<string>")).when((k == 2) & (n == 2), F.array(F.lit(" "))).when((k == 5) & (n == 3), F.array(F.lit("~ never said ~"))).otherwise(F.array(F.substring("text", 1, 12)))
    score = F.when((k == 4) & (n == 1), 6).otherwise(F.pmod(i + n, F.lit(5)) + 1)
    return filled, x.select(i.cast("string").alias("request_id"), "side", "dimension", score.cast("int").alias("score"), F.lit("because").alias("reason"), some.alias("evidence"))


@add("judgment_violations", f"""SELECT 'V18' AS rule_id, doc_id::varchar AS record_id, dimension AS detail FROM {JUDGED} WHERE score NOT BETWEEN 1 AND 5
  UNION ALL SELECT 'V17', doc_id::varchar, dimension FROM {JUDGED} WHERE kind <> 'ok' OR length(trim(substring((SELECT text FROM documents x WHERE x.doc_id = j.doc_id), 1, 12))) = 0
  UNION ALL SELECT 'V18', g.doc_id::varchar, g.side || '.' || g.dimension FROM (SELECT doc_id, side, dimension FROM labels JOIN documents USING (doc_id), (VALUES ('a'), ('b')) s(side), (VALUES {DIMS}) v(n, dimension)) g
    WHERE doc_id % 7 = 6 OR (doc_id % 7 = 3 AND side = 'b')""".replace(f"FROM {JUDGED} WHERE kind", f"FROM {JUDGED} j WHERE kind"))
def judgment_violations(spark, d):
    """Scores out of range, evidence that is missing, blank or not in the answer, and places of the grid without a judgment."""
    filled, given = judged(spark, d)
    text = F.when(F.col("side") == "a", F.col("response_a")).otherwise(F.col("response_b"))
    j = given.join(filled, "request_id").withColumn("text", text)
    return V.report([
        V.violations(j, "V18", F.col("request_id"), ~F.col("score").between(1, 5), F.col("dimension")),
        V.violations(j, "V17", F.col("request_id"), ~J.quoted(F.col("evidence"), F.col("text")), F.col("dimension")),
        J.incomplete(filled, given),
    ])


# ---- five-dimension reviews
FIVE = f"(SELECT d.lang, l.doc_id AS eval_id, v.variant, x.dimension, (l.doc_id * (x.n + 2) + CASE WHEN v.variant = 'tuned' THEN l.doc_id % 3 + ascii(d.lang) % 3 ELSE 0 END) % 5 + 1 AS score FROM labels l JOIN documents d USING (doc_id), (VALUES ('base'), ('tuned')) v(variant), (VALUES {DIMS}) x(n, dimension))"
CRITICAL = "(SELECT d.lang, l.doc_id AS eval_id, v.variant, (l.toxic = 1 AND d.lang IN ('de', 'fr') AND l.doc_id % CASE v.variant WHEN 'base' THEN 2 ELSE 3 END = 0) AS critical, CASE WHEN d.lang = 'es' AND l.doc_id % 9 = 0 THEN 3 ELSE 5 END AS safety FROM labels l JOIN documents d USING (doc_id), (VALUES ('base'), ('tuned')) v(variant) WHERE NOT (d.lang = 'fr' AND l.doc_id % 11 = 0))"
WON = "(SELECT d.lang, CASE (l.doc_id // 3 + ascii(d.lang)) % 4 WHEN 0 THEN 'tie' WHEN 1 THEN 'base' WHEN 2 THEN CASE WHEN ascii(d.lang) % 2 = 0 THEN 'base' ELSE 'tuned' END ELSE 'tuned' END AS winner FROM labels l JOIN documents d USING (doc_id))"


def reviewed(spark, d):
    return table(spark, d, "labels").select("doc_id", "toxic").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumnRenamed("doc_id", "eval_id")


def five(spark, d):
    x = reviewed(spark, d).withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("tuned")))).select("*", F.posexplode(F.array(*map(F.lit, J.DIMENSIONS))).alias("n", "dimension"))
    more = F.when(F.col("variant") == "tuned", F.pmod("eval_id", F.lit(3)) + F.ascii("lang") % 3).otherwise(0)
    return x.select("lang", "eval_id", "variant", "dimension", (F.pmod(F.col("eval_id") * (F.col("n") + 2) + more, F.lit(5)) + 1).alias("score"))


def critical(spark, d):
    x = reviewed(spark, d).withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("tuned")))).where(~((F.col("lang") == "fr") & (F.pmod("eval_id", F.lit(11)) == 0)))
    bad = (F.col("toxic") == 1) & F.col("lang").isin("de", "fr") & (F.pmod(F.col("eval_id"), F.when(F.col("variant") == "base", 2).otherwise(3)) == 0)
    return x.select("lang", "eval_id", "variant", bad.alias("critical"), F.when((F.col("lang") == "es") & (F.pmod("eval_id", F.lit(9)) == 0), 3).otherwise(5).alias("safety"))


PERSONA = ", ".join(map(S.q, config.PERSONA_DIMENSIONS))
MEANS = f"(SELECT lang, variant, dimension, round(avg(score) + 1e-9::double, 4) AS mean, count(*)::bigint AS n FROM (SELECT lang, eval_id, variant, dimension, score::double AS score FROM {FIVE} UNION ALL SELECT lang, eval_id, variant, 'persona_mean', avg(score) FROM {FIVE} WHERE dimension IN ({PERSONA}) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)"


@add("persona_means", f"SELECT * FROM {MEANS}")
def persona_means(spark, d):
    """Mean of each of five dimensions and of the persona score, per language and variant."""
    return R.persona_means(five(spark, d), "lang")


@add("decision_flags", f"""WITH p AS (SELECT lang, dimension, round(max(mean) FILTER (variant = 'tuned') - max(mean) FILTER (variant = 'base') + 1e-9::double, 4) AS delta FROM {MEANS} GROUP BY 1, 2),
  s AS (SELECT lang, max(delta) FILTER (dimension = 'persona_mean') AS persona_delta, bool_and(delta >= {config.CORE_DELTA}) FILTER (dimension IN ({', '.join(map(S.q, config.CORE_DIMENSIONS))})) AS core_kept FROM p GROUP BY 1),
  o AS (SELECT lang, eval_id, bool_or(critical) FILTER (variant = 'base') AS b, bool_or(critical) FILTER (variant = 'tuned') AS t, max(safety) FILTER (variant = 'tuned') AS s, count(*) AS n FROM {CRITICAL} GROUP BY 1, 2),
  g AS (SELECT d.lang, bool_and(coalesce(o.n = 2, false)) AS complete, sum(coalesce(t OR s < 4, false)::int)::bigint AS failures, sum(coalesce(NOT b AND t, false)::int)::bigint AS new_critical FROM labels l JOIN documents d USING (doc_id) LEFT JOIN o ON o.lang = d.lang AND o.eval_id = l.doc_id GROUP BY 1),
  w AS (SELECT lang, round(sum((winner = 'tuned')::int)::double / nullif(sum((winner <> 'tie')::int), 0) + 1e-9::double, 4) AS decisive_rate FROM {WON} GROUP BY 1),
  f AS (SELECT *, persona_delta >= {config.PERSONA_DELTA} OR coalesce(decisive_rate >= {config.WIN_RATE}, false) AS persona_improved, complete AND failures = 0 AS gate_passes FROM s JOIN g USING (lang) JOIN w USING (lang))
  SELECT lang, persona_delta, core_kept, complete, failures, new_critical, decisive_rate, persona_improved, gate_passes, persona_improved AND core_kept AND gate_passes AND new_critical = 0 AS accepted FROM f""")
def decision_flags(spark, d):
    """The decision per language: protocol complete, gate, persona, core, and nothing newly critical."""
    at = (F.floor(F.col("eval_id") / 3) + F.ascii("lang")) % 4
    won = reviewed(spark, d).select("lang", F.when(at == 0, "tie").when(at == 1, "base").when((at == 2) & (F.ascii("lang") % 2 == 0), "base").otherwise("tuned").alias("winner"))
    return R.review_decision(five(spark, d), critical(spark, d), won, reviewed(spark, d).select("lang", "eval_id"), "lang")


@add("layer_preferences", f"SELECT dimension, sum((p = 1)::int)::bigint AS wins, sum((p = -1)::int)::bigint AS losses, sum((p = 0)::int)::bigint AS ties, round(sum((p = 1)::int)::double / nullif(sum((p <> 0)::int), 0) + 1e-9::double, 4) AS decisive_rate FROM (SELECT dimension, sign(max(score) FILTER (variant = 'tuned') - max(score) FILTER (variant = 'base')) AS p FROM {FIVE} GROUP BY eval_id, dimension) GROUP BY dimension")
def layer_preferences(spark, d):
    """Wins, losses and ties of the tuned side in each dimension."""
    at = lambda v: F.max(F.when(F.col("variant") == v, F.col("score")))
    per = five(spark, d).groupBy("eval_id", "dimension").agg((at("tuned") - at("base")).alias("by"))
    return R.win_tie_loss(per.select("dimension", F.when(F.col("by") > 0, "tuned").when(F.col("by") < 0, "base").otherwise("tie").alias("winner")), "dimension")


@add("variant_summary", f"SELECT variant, layer, metric, round(avg(value) + 1e-9::double, 4) AS mean, count(*)::bigint AS n FROM (SELECT variant, {case('dimension', {'surface_style': 'surface', 'knowledge_relationship': 'knowledge', 'value_worldview': 'values'}, chr(39) + 'guard' + chr(39))} AS layer, dimension AS metric, (score - 1) * 25.0::double AS value FROM {FIVE}) GROUP BY 1, 2, 3")
def variant_summary(spark, d):
    """Means of every judged metric on 0..100, per variant and layer, the guard dimensions apart."""
    layer = F.coalesce(E.mapped(F.col("dimension"), {"surface_style": "surface", "knowledge_relationship": "knowledge", "value_worldview": "values"}), F.lit("guard"))
    x = five(spark, d).select("variant", layer.alias("layer"), F.col("dimension").alias("metric"), ((F.col("score") - 1) * 25.0).alias("value"))
    return x.groupBy("variant", "layer", "metric").agg(F.round(F.avg("value") + 1e-9, 4).alias("mean"), F.count("*").alias("n"))


# ---- two answers a labelled document, scored by rules and judge together
TAIL = " this thing, never a moron!"
ANSWERS = f"(SELECT r.doc_id AS eval_id, v.variant, CASE v.variant WHEN 'base' THEN r.text ELSE r.text || {S.q(TAIL)} END AS text, r.capability, r.serious, r.gold FROM labels l JOIN {texts.RESPONSES} r ON l.doc_id = r.doc_id, (VALUES ('base'), ('tuned')) v(variant))"
RULED = f"(SELECT eval_id, variant, {', '.join(f'{e} AS {m}' for m, e in texts.METRICS_SQL.items())} FROM {ANSWERS})"
MARKED = f"(SELECT eval_id, variant, {', '.join(f'(max(score) FILTER (dimension = {S.q(x)}) - 1) * 25.0::double AS {x}' for x in J.DIMENSIONS)} FROM {FIVE} GROUP BY 1, 2)"


def weighed(ws: dict[str, float], judge: str = "") -> str:
    return "round(" + " + ".join(f'{w}::double * "{judge if m == config.JUDGE_METRIC else m}"' for m, w in ws.items()) + " + 1e-9::double, 4)"


LAYERED = f"(SELECT *, {', '.join(f'{weighed(ws, config.JUDGED_DIMENSIONS[layer])} AS "{layer}"' for layer, ws in config.JUDGED_WEIGHTS.items())} FROM {RULED} JOIN {MARKED} USING (eval_id, variant))"
CANDIDATES = f"(SELECT *, {weighed(config.LAYER_WEIGHTS)} AS overall FROM {LAYERED})"


def candidates(spark, d):
    own = texts.responses(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id").withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("tuned"))))
    own = own.withColumn("text", F.when(F.col("variant") == "base", F.col("text")).otherwise(F.concat("text", F.lit(TAIL))))
    rules = texts.measured(own, texts.METRICS).select(F.col("doc_id").alias("eval_id"), "variant", *texts.METRICS)
    return J.candidate_scores(rules, five(spark, d).select("eval_id", "variant", "dimension", "score"), ["eval_id", "variant"])


SHOWN = ("eval_id", "variant", *config.JUDGED_WEIGHTS, "overall", *[x for x, kind in J.score_parts().items() if kind == "guard"])


@add("candidate_scores", f"SELECT {', '.join(f'"{c}"' for c in SHOWN)} FROM {CANDIDATES}")
def candidate_scores(spark, d):
    """Layers and overall score of each answer, the judge's metric among those of its layer, and the guard dimensions apart."""
    return candidates(spark, d).select(*SHOWN)


PARTS = J.score_parts()
UNPIVOT = f"(SELECT variant, unnest([{', '.join(map(S.q, PARTS.values()))}]) AS kind, unnest([{', '.join(map(S.q, PARTS))}]) AS part, unnest([{', '.join(f'"{p}"' for p in PARTS)}]) AS value FROM {CANDIDATES})"


@add("variant_means", f"SELECT *, round(tuned - base + 1e-9::double, 4) AS delta FROM (SELECT kind, part, round(avg(value) FILTER (variant = 'base') + 1e-9::double, 4) AS base, round(avg(value) FILTER (variant = 'tuned') + 1e-9::double, 4) AS tuned, count(*)::bigint AS answers FROM {UNPIVOT} GROUP BY 1, 2)")
def variant_means(spark, d):
    """Means of rule metrics, judged dimensions, layers, overall and guards by variant, and what the tuned one gains."""
    return J.variant_means(candidates(spark, d))


REVIEWS = "(SELECT doc_id AS eval_id, CASE WHEN doc_id % 13 = 0 THEN ' ' WHEN doc_id % 17 = 0 THEN NULL ELSE 'r1' END AS reviewer, toxic = 1 AS critical, CASE WHEN doc_id % 2 = 0 THEN 'seen' WHEN doc_id % 3 = 0 THEN '' END AS notes FROM labels WHERE toxic IS NOT NULL)"


@add("review_notes", f"SELECT 'V22' AS rule_id, eval_id::varchar AS record_id, 'reviewer' AS detail FROM {REVIEWS} WHERE trim(coalesce(reviewer, '')) = '' UNION ALL SELECT 'V22', eval_id::varchar, 'notes' FROM {REVIEWS} WHERE critical AND trim(coalesce(notes, '')) = ''")
def review_notes(spark, d):
    i = F.col("doc_id")
    every = lambda n: F.pmod(i, F.lit(n)) == 0
    x = table(spark, d, "labels").where("toxic IS NOT NULL").select(i.alias("eval_id"), F.when(every(13), " ").when(~every(17), "r1").alias("reviewer"), (F.col("toxic") == 1).alias("critical"), F.when(every(2), "seen").when(every(3), "").alias("notes"))
    return R.review_violations(x)


# ---- overrides and counts
MOVED = "(SELECT source AS scene, doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM documents WHERE doc_id % 19 = 0)"


@add("override_listing", f"SELECT scene, arg_max(split, seq) AS split, count(*)::bigint AS conflicts, count(DISTINCT split) > 1 AS conflicting FROM {MOVED} WHERE scene IS NOT NULL GROUP BY scene")
def override_listing(spark, d):
    """Overrides per scene: the last one holds; scenes that were moved to different splits are marked."""
    x = table(spark, d, "documents").where("doc_id % 19 = 0 AND source IS NOT NULL")
    split = F.when(F.pmod("doc_id", F.lit(3)) == 0, "train").when(F.pmod("doc_id", F.lit(3)) == 1, "validation").otherwise("test")
    return x.select(F.col("source").alias("scene"), F.col("doc_id").alias("seq"), split.alias("split")).groupBy("scene").agg(F.max_by("split", "seq").alias("split"), F.count("*").alias("conflicts"), (F.count_distinct("split") > 1).alias("conflicting"))


@add("override_coverage", f"SELECT coalesce(o.source, s.source) AS source, CASE WHEN o.source IS NULL THEN 'right' ELSE 'left' END AS side FROM (VALUES {', '.join(f'({S.q(k)})' for k in (*config.SPLIT_OVERRIDES, 'nowhere'))}) o(source) FULL JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s ON o.source = s.source WHERE o.source IS NULL OR s.source IS NULL")
def override_coverage(spark, d):
    """Groups that an override names and no record has, and the other way round."""
    named = spark.createDataFrame([(k,) for k in (*config.SPLIT_OVERRIDES, "nowhere")], "source string")
    return V.reconcile(named, table(spark, d, "documents").where("source IS NOT NULL"), "source")


@add("violation_counts", f"SELECT rule_id, count(*)::bigint AS n, count(DISTINCT record_id)::bigint AS records FROM ({relations.SQL['violation_report']}) GROUP BY rule_id")
def violation_counts(spark, d):
    return relations.violation_report(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))


# ---- fields of a filled sheet, as written, and corrections that must hit; faults in fixed shares of the ids
SHEET = """(SELECT doc_id AS review_id, CASE doc_id % 7 WHEN 0 THEN '6' WHEN 1 THEN ' 3 ' WHEN 2 THEN '3.0' ELSE (doc_id % 5 + 1)::varchar END AS score, CASE doc_id % 11 WHEN 0 THEN 'y' WHEN 1 THEN ' YES ' ELSE 'no' END AS critical,
  CASE doc_id % 13 WHEN 0 THEN 'c' WHEN 1 THEN ' TIE' ELSE 'a' END AS preference, CASE doc_id % 17 WHEN 0 THEN 'tone;tone' WHEN 1 THEN 'tone, odd' WHEN 2 THEN ' tone ; fact,' ELSE '' END AS tags FROM labels)"""
TAGS = "list_filter(list_transform(string_split_regex(tags, '[,;]'), lambda x: trim(x)), lambda x: x <> '')"
KNOWN = ", ".join(S.q(x) for x in config.ERROR_TAGS)


@add("sheet_field_violations", " UNION ALL ".join(f"SELECT 'P24' AS rule_id, review_id::varchar AS record_id, '{detail}' AS detail FROM {SHEET} WHERE {broken}" for detail, broken in (
    ("score", "NOT regexp_full_match(trim(score), '[1-5]')"), ("critical", "lower(trim(critical)) NOT IN ('yes', 'no')"), ("preference", "lower(trim(preference)) NOT IN ('a', 'b', 'tie')"),
    ("tags repeated", f"len({TAGS}) <> len(list_distinct({TAGS}))"), ("tags unknown", f"len(list_filter({TAGS}, lambda x: x NOT IN ({KNOWN}))) > 0"))))
def sheet_field_violations(spark, d):
    """Scores, flags, preferences and tags of a review sheet that cannot be read."""
    i = F.col("doc_id")

    def case(n, written, other):
        for k, text in reversed(list(enumerate(written))):
            other = F.when(F.pmod(i, F.lit(n)) == k, text).otherwise(other)
        return other

    sheet = table(spark, d, "labels").select(
        i.alias("review_id"), case(7, ["6", " 3 ", "3.0"], (F.pmod(i, F.lit(5)) + 1).cast("string")).alias("score"), case(11, ["y", " YES "], F.lit("no")).alias("critical"),
        case(13, ["c", " TIE"], F.lit("a")).alias("preference"), case(17, ["tone;tone", "tone, odd", " tone ; fact,"], F.lit("")).alias("tags"),
    )
    return E.sheet_violations(sheet, ["score"])


PATCHES = "(SELECT DISTINCT CASE WHEN conv_id % 50 = 3 THEN conv_id + 1000000000 ELSE conv_id END AS conv_id, CASE WHEN conv_id % 10 = 4 THEN 0 ELSE 1 END AS turn FROM conversations WHERE conv_id % 10 IN (3, 4))"


@add("patch_misses", f"SELECT 'P15' AS rule_id, p.conv_id::varchar || '.' || p.turn::varchar AS record_id, CASE WHEN m.own IS NULL THEN 'no such turn' ELSE 'not an assistant''s' END AS detail FROM {PATCHES} p LEFT JOIN (SELECT conv_id, turn, bool_and(role = 'assistant') AS own FROM conversations GROUP BY 1, 2) m ON m.conv_id = p.conv_id AND m.turn = p.turn WHERE NOT coalesce(m.own, false)")
def patch_misses(spark, d):
    """Corrections whose record or turn is not there, or is not the assistant's."""
    c, k = table(spark, d, "conversations"), F.pmod("conv_id", F.lit(10))
    moved = F.when(F.pmod("conv_id", F.lit(50)) == 3, F.col("conv_id") + 1_000_000_000).otherwise(F.col("conv_id"))
    patches = c.where(k.isin(3, 4)).select(moved.alias("conv_id"), F.when(k == 4, 0).otherwise(1).alias("turn")).distinct()
    return E.patch_violations(c.select("conv_id", "turn", "role"), patches)
