"""Queries on derived rows: supervised texts, provenance, summaries, rates, and stored rows against derived ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import canonical
from ..operators import derive as D
from ..sources.tables import table
from . import relations
from .records import FIVE, five

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


@add("supervised_text", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN last(text ORDER BY turn) ELSE string_agg(text, chr(10) ORDER BY turn) END AS supervised FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def supervised_text(spark, d):
    """The supervised text of a conversation by its policy: the last answer, or all of them."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"))
    policy = F.when(F.pmod("conv_id", F.lit(3)) == 0, "final_only").otherwise("all")
    return rows.select("conv_id", D.supervised_text(F.transform("said", lambda m: m["text"]), policy).alias("supervised"))


@add("allowed_tags", "SELECT event_id, array_to_string(list_filter(CASE WHEN event_id % 2 = 0 THEN ['view', event_type, 'other', 'click', event_type] ELSE [event_type, 'click', NULL, 'view'] END, lambda x: x IN ('click', 'view')), ',') AS kept FROM events")
def allowed_tags(spark, d):
    """Tags on a list, in the order in which they came, repeats included."""
    tags = F.when(F.pmod("event_id", F.lit(2)) == 0, F.array(F.lit("view"), "event_type", F.lit("other"), F.lit("click"), "event_type")).otherwise(F.array("event_type", F.lit("click"), F.lit(None), F.lit("view")))
    return table(spark, d, "events").select("event_id", F.array_join(D.allowed(tags, ["click", "view"]), ",").alias("kept"))


_RECORD = "{'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}"
_SOURCE = f"(SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line, lang, n_chars, source, text, sha256(to_json({_RECORD})::varchar) AS sha FROM documents)"


@add("provenance_structs", f"SELECT doc_id, sha256(to_json({{'dataset': 'documents', 'group': source, 'lang': lang, 'line': line, 'n_chars': n_chars, 'original_text': text, 'record_id': doc_id, 'record_sha256': sha}})::varchar) AS provenance_sha256, line FROM {_SOURCE}")
def provenance_structs(spark, d):
    """Where each document comes from, with nothing of it lost: dataset, line, hash of the record and all of its fields."""
    lines = relations.physical_line_map(spark, d).select("doc_id", "line")
    own = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").join(lines, "doc_id")
    x = D.with_source(own, "documents", "line", {"doc_id": "record_id", "source": "group", "text": "original_text"})
    return x.select("doc_id", F.sha2(canonical(F.col("source"), x.schema["source"].dataType), 256).alias("provenance_sha256"), "line")


@add("recomputed_rows", "SELECT doc_id, unnest(CASE doc_id % 19 WHEN 1 THEN ['missing'] WHEN 2 THEN ['repeated'] WHEN 3 THEN ['differs from what is derived'] WHEN 4 THEN ['repeated', 'differs from what is derived'] ELSE [] END) AS detail FROM documents UNION ALL SELECT -doc_id - 1, 'does not resolve' FROM documents WHERE doc_id % 19 = 5")
def recomputed_rows(spark, d):
    """Stored records, some of which were changed since, against the same records derived anew."""
    k = F.pmod("doc_id", F.lit(19))
    mode = F.struct((k + 1).cast("int").alias("seriousness"), F.split("source", "c").alias("parts"))
    derived = table(spark, d, "documents").select("doc_id", F.upper("lang").alias("code"), mode.alias("mode"), "text")
    copies = F.when(k == 1, F.array().cast("array<int>")).when(k == 2, F.array(F.lit(0), F.lit(0))).when(k == 4, F.array(F.lit(0), F.lit(1))).when(k == 5, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    stored = derived.withColumn("copy", F.explode(copies))
    changed = F.when((k == 3) | (F.col("copy") == 1), F.col("mode").withField("seriousness", F.lit(99))).otherwise(F.col("mode"))
    stored = stored.withColumn("mode", changed).withColumn("doc_id", F.when(F.col("copy") == 2, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))).drop("copy")
    return D.recomputed(stored, derived, "doc_id")


_RECORDS = f"(SELECT c.conv_id, p.capability, p.split, c.a FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id) c JOIN {relations.PLACED} p ON p.doc_id = c.conv_id)"
_EXAMPLES = f"(SELECT split, capability, unnest(range(CASE WHEN conv_id % 3 = 0 THEN least(a, 1) ELSE a END)) FROM {_RECORDS})"


@add("derived_summary", f"WITH r AS (SELECT split, capability, count(*) AS n, count(*) FILTER (a > 1) AS m FROM {_RECORDS} GROUP BY GROUPING SETS ((split), (split, capability))), e AS (SELECT split, capability, count(*) AS n FROM {_EXAMPLES} GROUP BY GROUPING SETS ((split), (split, capability))) SELECT r.split, r.capability, r.n::bigint AS source_records, r.m::bigint AS multi_turn_source_records, coalesce(e.n, 0)::bigint AS derived_examples FROM r LEFT JOIN e ON r.split = e.split AND r.capability IS NOT DISTINCT FROM e.capability")
def derived_summary(spark, d):
    """Records, multi-turn records and derived examples of each split, whole (capability null) and by capability."""
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("answers"))
    own = relations.placed(spark, d).select(F.col("doc_id").alias("conv_id"), "split", "capability")
    records = per.join(own, "conv_id")
    many = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.least("answers", F.lit(1))).otherwise(F.col("answers"))
    examples = records.withColumn("many", many).where("many > 0").select("split", "capability", F.explode(F.sequence(F.lit(1), F.col("many").cast("int"))))
    return D.summarized(records, examples, ["split"])


@add("safety_rates", f"SELECT variant, lang, count(*)::bigint AS responses, count(*) FILTER (critical)::bigint AS critical_failures, count(*) FILTER (NOT critical AND score >= 4)::bigint AS gate_passes, round(count(*) FILTER (critical)::double / count(*) + 1e-9::double, 4) AS critical_failure_rate, round(count(*) FILTER (NOT critical AND score >= 4)::double / count(*) + 1e-9::double, 4) AS gate_pass_rate FROM (SELECT f.variant, f.lang, f.score, f.eval_id % 7 = 0 AND f.variant = 'tuned' AS critical FROM {FIVE} f WHERE f.dimension = 'safety_ethics') GROUP BY variant, lang")
def safety_rates(spark, d):
    """Rates of critical failures and of passes of the safety gate by variant and language."""
    critical = (F.pmod("eval_id", F.lit(7)) == 0) & (F.col("variant") == "tuned")
    x = five(spark, d).where("dimension = 'safety_ethics'").select("variant", "lang", F.col("score").alias("safety_ethics"), critical.alias("critical"))
    return D.gate_rates(x, ["variant", "lang"])
