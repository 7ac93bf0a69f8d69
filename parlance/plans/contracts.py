"""Queries for whole contracts: comparisons, source records, blind keys, safety reviews, strict JSON, multisets; a fault of each kind is planted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as V
from ..operators import contracts as C
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


def found(rule: str, key: str, modulo: int, faults: dict[int, list[str]], frm: str, detail: str = "") -> str:
    """SQL of violation rows: by what remains of the key. detail: an expression in place of the fault's text, where it is 'own'."""
    rows = ", ".join(f"({k}, '{rule}', '{d}')" for k, ds in faults.items() for d in ds)
    told = f"CASE f.detail WHEN 'own' THEN {detail} ELSE f.detail END" if detail else "f.detail"
    return f"SELECT f.rule_id, {key}::varchar AS record_id, {told} AS detail FROM {frm} JOIN (VALUES {rows}) f(k, rule_id, detail) ON {key} % {modulo} = f.k"


@add("comparison_violations", found("V27", "doc_id", 17, {1: ["labels are equal"], 2: ["prompt_equal is not honest"], 3: ["prompt hash"], 4: ["blank response"], 5: ["not greedy"], 6: ["not greedy"]}, "documents") + " UNION ALL SELECT 'S8', doc_id::varchar, '2' FROM documents WHERE doc_id % 17 = 7")
def comparison_violations(spark, d):
    """Recorded comparisons: model names, prompts and their hashes, answers, decoding, unique ids."""
    i = F.col("doc_id")
    k = F.pmod(i, F.lit(17))
    at = lambda n, a, b: F.when(k == n, a).otherwise(b)
    prompt = F.concat(F.lit("prompt "), i.cast("string"))
    side = lambda label, said, sha: F.struct(label.alias("model_label"), prompt.alias("prompt"), sha.alias("prompt_sha256"), said.alias("response"))
    sha = F.sha2(prompt, 256)
    # a hash that is wrong on both sides alike leaves prompt_equal honest
    base, tuned = side(F.lit("base"), at(4, F.lit(" "), F.col("text")), at(3, F.lit("0"), sha)), side(at(1, F.lit("base"), F.lit("tuned")), F.col("text"), at(3, F.lit("0"), sha))
    x = table(spark, d, "documents").select(i.alias("eval_id"), base.alias("base"), tuned.alias("tuned"), at(2, F.lit(False), F.lit(True)).alias("prompt_equal"), at(5, F.lit(True), F.lit(False)).alias("do_sample"), at(6, F.lit(4), F.lit(1)).alias("num_beams"))
    twice = F.when(F.pmod("eval_id", F.lit(17)) == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return C.comparison_violations(x.withColumn("copy", F.explode(twice)).drop("copy"))


@add("source_record_violations", found("V30", "doc_id", 13, {1: ["validation"], 2: ["sometimes"], 3: ["final_only"]}, "documents") + " UNION ALL " + found("V3", "doc_id", 13, {4: ["1"], 5: ["2"], 6: ["3"], 7: ["2"]}, "documents"))
def source_record_violations(spark, d):
    """Source records: the group's split, the policy of a kind, the order of roles, blank content."""
    i = F.col("doc_id")
    k = F.pmod(i, F.lit(13))
    m = lambda role, text="x": F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    talk = F.when(k == 4, F.array(m("user"))).when(k == 5, F.array(m("assistant"), m("user"))).when(k == 6, F.array(m("user"), m("system"), m("assistant"))).when(k == 7, F.array(m("user"), m("assistant", " "))).otherwise(F.array(m("system"), m("user"), m("assistant")))
    x = table(spark, d, "documents").select(
        i.alias("id"), F.when(k == 1, "g1").otherwise("g2").alias("group_id"), F.when(k == 1, "validation").otherwise("test").alias("split"), F.when(k == 3, "curated").otherwise("imported").alias("kind"),
        F.when(k == 2, "sometimes").when((k == 3) | (k == 8), "final_only").alias("policy"), talk.alias("messages"),
    )
    return C.source_record_violations(x, {"g1": "train", "g2": "test"})


@add("key_violations", found("V24", "doc_id", 11, {1: ["2"], 2: ["base"], 3: ["short"]}, "documents") + " UNION ALL SELECT 'V24', 'key', (count(*) + count(*) FILTER (doc_id % 11 = 1))::varchar FROM documents")
def key_violations(spark, d):
    """A blind key: unique requests, both variants, hashes, and as many rows as were asked for."""
    k = F.pmod("doc_id", F.lit(11))
    twice = F.when(k == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    x = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.lit("base").alias("a_variant"), F.when(k == 2, "base").otherwise("tuned").alias("b_variant"), F.when(k == 3, "short").otherwise(F.sha2("text", 256)).alias("core_sha256"), F.explode(twice).alias("copy"))
    return C.key_violations(x.drop("copy"), rows=-1)


_CRITICAL = "(SELECT conv_id, bool_or(conv_id % 4 = 1 AND turn = 1 OR conv_id % 6 = 0 AND turn % 2 = 1) AS critical FROM conversations GROUP BY conv_id)"


def reviewed(spark, d):
    """Answers by turn; a record is critical when one of its turns is."""
    own = table(spark, d, "conversations").where("turn % 2 = 1")
    i, t = F.col("conv_id"), F.col("turn")
    x = own.select(i.alias("record_id"), "turn", F.col("text").alias("response"), F.when((F.pmod(i, F.lit(4)) == 1) & (t == 1), "safety").otherwise("daily").alias("capability"), F.when(F.pmod(i, F.lit(6)) == 0, F.array(F.lit(" Harm"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"))
    return C.critical_rows(x, ["safety"], ["harm"])


@add("critical_records", f"SELECT conv_id AS record_id, turn, critical FROM conversations JOIN {_CRITICAL} USING (conv_id) WHERE turn % 2 = 1")
def critical_records(spark, d):
    """Turns with whether their record is critical: one turn makes it so."""
    return reviewed(spark, d).select("record_id", "turn", "critical")


_ASKED = f"(SELECT DISTINCT conv_id FROM conversations JOIN {_CRITICAL} USING (conv_id) WHERE turn % 2 = 1 AND critical)"
_OUTCOMES = {1: ("integrity", "turns"), 2: ("integrity", "reviewer"), 3: ("integrity", "record"), 5: ("human", "calm,refers")}


@add("safety_review_outcomes", f"SELECT conv_id AS record_id, f.class, f.detail FROM {_ASKED} JOIN (VALUES {', '.join(f'({k}, {chr(39)}{c}{chr(39)}, {chr(39)}{t}{chr(39)})' for k, (c, t) in _OUTCOMES.items())}) f(k, class, detail) ON conv_id % 7 = f.k")
def safety_review_outcomes(spark, d):
    """A safety review, filled in, against its template: what was altered or left open apart from what people judged as failing."""
    checks = ["calm", "refers"]
    template = C.safety_template(reviewed(spark, d), checks)
    k = F.pmod("record_id", F.lit(7))
    said = F.when(k == 5, "FAIL ").otherwise("pass")
    filled = template.where(k != 3).withColumns({"reviewer": F.when(k == 2, " ").otherwise("r"), "answers": F.transform_values("answers", lambda name, value: said), "turns": F.when(k == 1, F.transform("turns", lambda t: t.withField("response", F.lit("other")))).otherwise(F.col("turns"))})
    return C.safety_outcome(filled, template, checks)


@add("strict_json_keys", "SELECT event_id, CASE WHEN event_id % 9 IN (1, 2) THEN NULL ELSE event_id % 9 = 0 OR event_id % 9 > 4 END AS whole, CASE event_id % 9 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'n' ELSE '' END AS missing, CASE event_id % 9 WHEN 4 THEN 'extra' ELSE '' END AS unexpected, event_id % 9 IN (0, 4, 7, 8) AS integer FROM events".replace("event_id % 9 = 0 OR event_id % 9 > 4", "event_id % 9 NOT IN (3, 4)"))
def strict_json_keys(spark, d):
    """Strict JSON objects with exactly the expected keys, and whether a field is an integer: no boolean, no text, no fraction."""
    i = F.col("event_id").cast("string")
    k = F.pmod("event_id", F.lit(9))
    id_ = F.concat(F.lit('{"id":'), i)
    n = F.when(k == 5, ',"n":true}').when(k == 6, ',"n":"1"}').otherwise(',"n":1}')
    doc = F.when(k == 1, F.concat(id_, F.lit(',"n":1,"n":2}'))).when(k == 2, F.concat(id_, F.lit(',"n":NaN}'))).when(k == 3, F.concat(id_, F.lit("}"))).when(k == 4, F.concat(id_, F.lit(',"n":1,"extra":null}'))).otherwise(F.concat(id_, n))
    x = table(spark, d, "events").select("event_id", doc.alias("doc"))
    differ = V.keys_differ(F.col("doc"), ["id", "n"])
    strict = V.strict_json(F.col("doc")).isNotNull()
    none = F.array().cast("array<string>")
    x = x.select("event_id", strict.alias("strict"), F.when(strict, differ["missing"]).otherwise(none).alias("m"), F.when(strict, differ["unexpected"]).otherwise(none).alias("u"), V.is_integer(F.col("doc"), "$.n").alias("integer"))
    return x.select("event_id", F.when(F.col("strict"), (F.size("m") == 0) & (F.size("u") == 0)).alias("whole"), F.array_join("m", ",").alias("missing"), F.array_join("u", ",").alias("unexpected"), "integer")


@add("multiset_difference", "WITH a AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL UNION ALL SELECT 'none', 'xx', 2) SELECT coalesce(a.source, b.source) AS source, coalesce(a.lang, b.lang) AS lang, abs(coalesce(a.n, 0) - coalesce(b.n, 0))::bigint AS more, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.source IS NOT DISTINCT FROM b.source AND a.lang IS NOT DISTINCT FROM b.lang WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def multiset_difference(spark, d):
    """Rows that one side has more often than the other, with the side and by how many."""
    own = table(spark, d, "documents")
    other = own.where("doc_id % 5 <> 0").select("source", "lang").unionByName(spark.createDataFrame([("none", "xx")] * 2, "source string, lang string"))
    return V.multiset_differs(own.select("source", "lang"), other).select("source", "lang", F.col("more").cast("long").alias("more"), "side")
