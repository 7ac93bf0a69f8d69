"""Queries on relations: counts, pivots, duplicates, leaks, joins, set operations, windows and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import checks as V
from ..sources.tables import table
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


def docs(spark, d):
    return table(spark, d, "documents")


def quoted(xs) -> str:
    return ", ".join(S.q(x) for x in xs)


CAP = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.CAPABILITIES.items()) + " END"
#: Split of a document: by its group's number, unless the group is moved.
SPLIT = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.SPLIT_OVERRIDES.items()) + " ELSE CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END END"


def placed(spark, d):
    """documents with capability, base split and split; overrides come by a left join with a small table and a default."""
    moved = spark.createDataFrame(list(config.SPLIT_OVERRIDES.items()), "source string, moved string")
    base = F.when(F.pmod("doc_id", F.lit(10)) < 8, "train").when(F.pmod("doc_id", F.lit(10)) == 8, "validation").otherwise("test")
    own = docs(spark, d).withColumns({"capability": X.mapped(F.col("lang"), config.CAPABILITIES), "base_split": base})
    return own.join(F.broadcast(moved), "source", "left").withColumn("split", F.coalesce("moved", "base_split"))


PLACED = f"(SELECT *, {CAP} AS capability, {SPLIT} AS split FROM documents)"


@add("split_override", f"SELECT doc_id, split FROM {PLACED}")
def split_override(spark, d):
    return placed(spark, d).select("doc_id", "split")


@add("override_distribution_diff", "WITH p AS (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS base FROM " + PLACED + ") SELECT coalesce(a.split, b.base) AS split, coalesce(a.n, 0)::bigint AS n, coalesce(b.n, 0)::bigint AS base_n FROM (SELECT split, count(*) n FROM p GROUP BY 1) a FULL JOIN (SELECT base, count(*) n FROM p GROUP BY 1) b ON a.split = b.base")
def override_distribution_diff(spark, d):
    p = placed(spark, d)
    a, b = p.groupBy("split").agg(F.count("*").alias("n")), p.groupBy(F.col("base_split").alias("split")).agg(F.count("*").alias("base_n"))
    return a.join(b, "split", "full_outer").select("split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("base_n", F.lit(0)).alias("base_n"))


@add("source_counts", "SELECT source, count(*)::bigint AS n, count(DISTINCT lang)::bigint AS langs FROM documents GROUP BY source")
def source_counts(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@add("distinct_groups", "SELECT count(DISTINCT source)::bigint AS n_groups, count(DISTINCT doc_id)::bigint AS n_records FROM documents")
def distinct_groups(spark, d):
    return docs(spark, d).agg(F.count_distinct("source").alias("n_groups"), F.count_distinct("doc_id").alias("n_records"))


@add("capability_split_pivot", "SELECT c.capability, " + ", ".join(f"coalesce(sum(CASE WHEN p.split = '{s}' THEN 1 ELSE 0 END), 0)::bigint AS n_{s}" for s in config.SPLITS) + " FROM (SELECT unnest([" + quoted([*config.CAPABILITIES.values(), "spare"]) + f"]) AS capability) c LEFT JOIN {PLACED} p USING (capability) GROUP BY c.capability")
def capability_split_pivot(spark, d):
    """Counts for every expected capability, zero where there are none: aggregated first, then joined to the expectation."""
    expected = spark.createDataFrame([(c,) for c in [*config.CAPABILITIES.values(), "spare"]], "capability string")
    counts = placed(spark, d).groupBy("capability").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in config.SPLITS])
    return F.broadcast(expected).join(counts, "capability", "left").fillna(0)


@add("multi_turn_ratio", "SELECT count(*)::bigint AS n, sum((a > 1)::int)::bigint AS multi, round(sum((a > 1)::int)::double / count(*), 6) AS ratio FROM (SELECT conv_id, sum((role = 'assistant')::int) AS a FROM conversations GROUP BY conv_id)")
def multi_turn_ratio(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a"))
    return per.agg(F.count("*").alias("n"), F.count_if(F.col("a") > 1).alias("multi")).withColumn("ratio", F.round(F.col("multi") / F.col("n"), 6))


@add("supervised_turns_by_split", "SELECT split, sum(CASE WHEN final_only THEN least(a, 1) ELSE a END)::bigint AS supervised FROM (SELECT conv_id, conv_id % 3 = 0 AS final_only, CASE conv_id % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END AS split, sum((role = 'assistant')::int) AS a FROM conversations GROUP BY conv_id) GROUP BY split")
def supervised_turns_by_split(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a"))
    k = F.pmod("conv_id", F.lit(5))
    per = per.select(F.when(k == 3, "validation").when(k == 4, "test").otherwise("train").alias("split"), F.when(F.pmod("conv_id", F.lit(3)) == 0, F.least("a", F.lit(1))).otherwise(F.col("a")).alias("s"))
    return per.groupBy("split").agg(F.sum("s").alias("supervised"))


@add("length_summary", rf"SELECT lang, min(v)::bigint AS shortest, round(median(v)::double, 4) AS median, round(avg(v), 2) AS mean, max(v)::bigint AS longest, sum(v)::bigint AS total FROM (SELECT lang, {S.visible('text')} AS v FROM documents) GROUP BY lang")
def length_summary(spark, d):
    v = docs(spark, d).select("lang", X.visible_length(F.col("text")).alias("v"))
    return v.groupBy("lang").agg(F.min("v").alias("shortest"), F.round(F.median("v"), 4).alias("median"), F.round(F.avg("v"), 2).alias("mean"), F.max("v").alias("longest"), F.sum("v").alias("total"))


@add("percentile_lengths", "SELECT lang, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM documents GROUP BY lang")
def percentile_lengths(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.round(F.percentile("n_chars", 0.5), 4).alias("p50"), F.round(F.percentile("n_chars", 0.95), 4).alias("p95"))


@add("duplicate_ids", "SELECT id, count(*)::bigint AS n FROM (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels WHERE quality = 1) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    ids = docs(spark, d).select(F.col("doc_id").alias("id")).unionAll(table(spark, d, "labels").where("quality = 1").select("doc_id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@add("duplicate_normalized_text", f"SELECT sha256(k) AS text_key, doc_id, n FROM (SELECT k, doc_id, count(*) OVER (PARTITION BY k)::bigint AS n FROM (SELECT doc_id, {S.normalized('text')} AS k FROM documents) WHERE k <> '') WHERE n > 1")
def duplicate_normalized_text(spark, d):
    """A row for each record of a text that others have too, so that no list grows with a group. The key is hashed
    before the shuffle: what moves is 64 bytes and an id, not the text."""
    k = X.normalized(F.col("text"))
    own = docs(spark, d).select("doc_id", F.when(k != "", F.sha2(k, 256)).alias("text_key")).where("text_key IS NOT NULL")
    return own.join(own.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1"), "text_key").select("text_key", "doc_id", "n")


@add("duplicate_policy", f"SELECT sha256(k) AS text_key, count(*)::bigint AS n, count(DISTINCT source) = 1 AND bool_and(lang = 'en') AS allowed FROM (SELECT *, {S.normalized('text')} AS k FROM documents) WHERE k <> '' GROUP BY k HAVING count(*) > 1")
def duplicate_policy(spark, d):
    """Repeated targets are allowed within one group of one kind only."""
    k = X.normalized(F.col("text"))
    own = docs(spark, d).select("source", "lang", F.when(k != "", F.sha2(k, 256)).alias("text_key")).where("text_key IS NOT NULL")
    return own.groupBy("text_key").agg(F.count("*").alias("n"), ((F.min("source").eqNullSafe(F.max("source"))) & F.every(F.col("lang") == "en")).alias("allowed")).where("n > 1")


@add("group_leakage", f"SELECT sha256(k) AS text_key, count(DISTINCT split)::bigint AS n_splits FROM (SELECT split, {S.normalized('text')} AS k FROM {PLACED}) WHERE k <> '' GROUP BY k HAVING count(DISTINCT split) > 1")
def group_leakage(spark, d):
    """Groups of one normalized text whose records are in more than one split."""
    k = X.normalized(F.col("text"))
    own = placed(spark, d).select("split", F.when(k != "", F.sha2(k, 256)).alias("text_key")).where("text_key IS NOT NULL")
    return own.groupBy("text_key").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


@add("variant_completeness", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, list_sort(list(DISTINCT lang)) = ['de', 'en', 'es', 'fr'] AS complete FROM documents GROUP BY source")
def variant_completeness(spark, d):
    have = F.array_sort(F.collect_set("lang"))
    return docs(spark, d).groupBy("source").agg(F.array_join(have, ",").alias("langs"), (have == F.array(*map(F.lit, ["de", "en", "es", "fr"]))).alias("complete"))


@add("functional_dependency", f"SELECT capability, count(*)::bigint AS records FROM (SELECT l.doc_id, count(DISTINCT p.capability) AS k, min(p.capability) AS capability FROM labels l JOIN {PLACED} p USING (doc_id) GROUP BY l.doc_id) WHERE k = 1 GROUP BY capability")
def functional_dependency(spark, d):
    per = table(spark, d, "labels").join(placed(spark, d), "doc_id").groupBy("doc_id").agg(F.count_distinct("capability").alias("k"), F.min("capability").alias("capability"))
    return per.where("k = 1").groupBy("capability").agg(F.count("*").alias("records"))


@add("provenance_left_join", "SELECT d.doc_id, d.source, l.quality, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l USING (doc_id)")
def provenance_left_join(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("known")), "doc_id", "left").select("doc_id", "source", "quality", F.coalesce("known", F.lit(False)).alias("known"))


@add("copied_reply_semi", f"SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first FROM (SELECT doc_id, {S.normalized('text')} AS k FROM documents) WHERE k <> '') WHERE doc_id > first")
def copied_reply_semi(spark, d):
    """Texts that a smaller doc_id has too, over the whole table: texts meet as hashes."""
    k = X.normalized(F.col("text"))
    own = docs(spark, d).select("doc_id", F.when(k != "", F.sha2(k, 256)).alias("k")).where("k IS NOT NULL")
    first = own.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return own.join(first, "k").where("doc_id > first").select("doc_id")


@add("unlabelled_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(spark, d):
    return docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def grams(text, mark, n):
    """Hashes of all runs of n parts of a text, cut at a mark (none: characters). Cut and hashed once, whatever the length."""
    def runs(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(n)]))

    return X.let(F.transform(F.split(text, mark), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= n, F.array_distinct(runs(h))))


CHARS = 8  # the shortest excerpt that can be searched


def holding(texts, excerpts):
    """(doc_id, item_id) where the text holds the excerpt, of eight characters at least.

    An excerpt's words after the first and before the last stand between spaces wherever it occurs, so up to four of
    them are an equi-key; excerpts of one or two words have their first characters as key instead. Which kinds of key there are
    is asked first (five at most), as each costs a pass over the texts. Only texts that share a key are searched."""
    w = F.split("excerpt", " ")
    kinds = excerpts.where(F.length("excerpt") >= CHARS).withColumn("kind", F.greatest(F.lit(0), F.least(F.lit(4), F.size(w) - 2)))
    met = None
    for (kind,) in kinds.select("kind").distinct().collect():
        mark, first, n = (" ", 2, kind) if kind else ("", 1, CHARS)
        parts = F.split("excerpt", mark)
        key = F.xxhash64(*[F.xxhash64(F.element_at(parts, first + j)) for j in range(n)])
        some = kinds.where(F.col("kind") == kind).select("item_id", "excerpt", key.alias("gram"))
        one = texts.select("doc_id", F.explode(grams(F.col("text"), mark, n)).alias("gram")).join(some, "gram").select("doc_id", "item_id", "excerpt")
        met = one if met is None else met.unionByName(one)
    if met is None:
        return texts.select("doc_id", F.lit(None).cast(excerpts.schema["item_id"].dataType).alias("item_id")).limit(0)
    return met.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", "excerpt")).select("doc_id", "item_id").distinct()


@add("protected_excerpt_hits", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(trim(b.text)) >= 8 AND contains(d.text, b.text)")
def protected_excerpt_hits(spark, d):
    """Every protected excerpt against every text."""
    return holding(docs(spark, d), table(spark, d, "benchmark").where(F.length(F.trim("text")) >= 8).select("item_id", F.col("text").alias("excerpt")))


@add("guarded_containment", "SELECT d.doc_id, b.item_id, CASE WHEN d.text = b.text THEN 'equal' ELSE 'contained' END AS how FROM documents d JOIN benchmark b ON d.text = b.text OR (length(b.text) >= 20 AND contains(d.text, b.text))")
def guarded_containment(spark, d):
    """Texts equal to a reference text of any length, or that hold one of 20 characters and more."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("excerpt"))
    same = docs(spark, d).join(b, F.col("text") == F.col("excerpt")).select("doc_id", "item_id", F.lit("equal").alias("how"))
    inside = holding(docs(spark, d), b.where(F.length("excerpt") >= 20)).join(same.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    return same.unionByName(inside.withColumn("how", F.lit("contained")))


@add("id_reconciliation", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def id_reconciliation(spark, d):
    return V.reconcile(docs(spark, d), table(spark, d, "labels"), "doc_id")


@add("row_version_compare", "SELECT a.doc_id, a.lang IS NOT DISTINCT FROM b.lang AS same_lang, a.source IS NOT DISTINCT FROM b.source AS same_source, a.text IS NOT DISTINCT FROM b.text AS same_text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE NOT (a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source AND a.text IS NOT DISTINCT FROM b.text)")
def row_version_compare(spark, d):
    """Null-safe comparison of two versions of a row; texts meet as hashes."""
    a = docs(spark, d).select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("l2"), F.col("source").alias("s2"), F.col("h").alias("h2"))
    x = a.join(b, "doc_id").select("doc_id", F.col("lang").eqNullSafe(F.col("l2")).alias("same_lang"), F.col("source").eqNullSafe(F.col("s2")).alias("same_source"), F.col("h").eqNullSafe(F.col("h2")).alias("same_text"))
    return x.where("NOT (same_lang AND same_source AND same_text)")


@add("record_set_except", "SELECT lang, source FROM documents EXCEPT SELECT lang, source FROM documents d JOIN labels USING (doc_id)")
def record_set_except(spark, d):
    own = docs(spark, d)
    return own.select("lang", "source").subtract(own.join(table(spark, d, "labels"), "doc_id").select("lang", "source"))


@add("record_union", "SELECT lang, source FROM documents WHERE doc_id % 2 = 0 UNION SELECT lang, source FROM documents WHERE doc_id % 3 = 0")
def record_union(spark, d):
    own = docs(spark, d)
    return own.where("doc_id % 2 = 0").select("lang", "source").unionByName(own.where("doc_id % 3 = 0").select("lang", "source")).distinct()


@add("record_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def record_intersect(spark, d):
    return docs(spark, d).select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@add("multiset_except", "SELECT source, lang FROM documents EXCEPT ALL SELECT source, lang FROM documents WHERE doc_id % 2 = 0")
def multiset_except(spark, d):
    own = docs(spark, d).select("doc_id", "source", "lang")
    return own.select("source", "lang").exceptAll(own.where("doc_id % 2 = 0").select("source", "lang"))


LENGTHS = "(SELECT 'V9' AS rule_id, doc_id::varchar AS record_id, n_chars::varchar AS detail FROM documents WHERE NOT n_chars BETWEEN 15 AND 4200)"
PHRASES = f"(SELECT 'V10', doc_id::varchar, source FROM documents WHERE {S.any_of('text', config.FORBIDDEN_PHRASES)})"
TERMS = f"(SELECT 'V11', doc_id::varchar, lang FROM documents WHERE (doc_id % 5 + 1 >= 4 AND {S.any_of('text', config.FORBIDDEN_SERIOUS)}) OR (lang = 'es' AND {S.any_of('text', config.FORBIDDEN_SAFETY)}))"
NEEDED = f"(SELECT 'V12', doc_id::varchar, lang FROM documents WHERE doc_id % 4 = 0 AND NOT {S.any_of('text', config.REQUIRED_ANY)})"


@add("violation_report", f"{LENGTHS} UNION ALL {PHRASES} UNION ALL {TERMS} UNION ALL {NEEDED}")
def violation_report(spark, d):
    """Length window, forbidden phrases, terms gated by seriousness and capability, terms required by a flag: one report."""
    own, t, i = docs(spark, d), F.col("text"), F.col("doc_id")
    serious = F.pmod(i, F.lit(5)) + 1 >= 4
    gated = (serious & X.any_term(t, config.FORBIDDEN_SERIOUS)) | ((F.col("lang") == "es") & X.any_term(t, config.FORBIDDEN_SAFETY))
    return V.report([
        V.violations(own, "V9", i, ~F.col("n_chars").between(15, 4200), F.col("n_chars")),
        V.violations(own, "V10", i, X.any_term(t, config.FORBIDDEN_PHRASES), F.col("source")),
        V.violations(own, "V11", i, gated, F.col("lang")),
        V.violations(own, "V12", i, (F.pmod(i, F.lit(4)) == 0) & ~X.any_term(t, config.REQUIRED_ANY), F.col("lang")),
    ])


@add("physical_line_map", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line, source FROM documents")
def physical_line_map(spark, d):
    """Numbered within ranges of ids, and offset by the ranges before: a file of any size is numbered in pieces."""
    own = docs(spark, d).select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 4096).alias("range"))
    sizes = own.groupBy("lang", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("lang", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("lang", "range").orderBy("doc_id"))
    return own.withColumn("inside", inside).join(offsets, ["lang", "range"]).select("doc_id", (F.col("inside") + F.col("before")).cast("long").alias("line"), "source")


@add("legacy_ref_resolve", "WITH m AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line FROM documents) SELECT r.doc_id, r.ref, m.doc_id AS target FROM (SELECT doc_id, 'data/' || lang || '.jsonl:L' || (doc_id % 97 + 1)::varchar AS ref, lang, doc_id % 97 + 1 AS line FROM documents) r LEFT JOIN m ON r.lang = m.lang AND r.line = m.line")
def legacy_ref_resolve(spark, d):
    """References of the form data/<split>.jsonl:L<n> to the records at those lines; unresolved ones stay null."""
    own = docs(spark, d).select("doc_id", "lang")
    ref = F.concat(F.lit("data/"), F.col("lang"), F.lit(".jsonl:L"), (F.pmod("doc_id", F.lit(97)) + 1).cast("string"))
    refs = own.select("doc_id", ref.alias("ref")).withColumns({"lang": F.regexp_extract("ref", r"^data/(\w+)\.jsonl:L(\d+)$", 1), "line": F.regexp_extract("ref", r"^data/(\w+)\.jsonl:L(\d+)$", 2).cast("long")})
    lines = physical_line_map(spark, d).join(own, "doc_id").select(F.col("doc_id").alias("target"), "lang", "line")
    return refs.join(lines, ["lang", "line"], "left").select("doc_id", "ref", "target")


@add("first_per_group", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_per_group(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.min("doc_id").alias("doc_id"))


@add("first_k_samples", "SELECT source, doc_id, k FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 2")
def first_k_samples(spark, d):
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    return docs(spark, d).select("source", "doc_id", k.alias("k")).where("k <= 2")


@add("tag_frequency", "SELECT tag, count(*)::bigint AS n FROM (SELECT unnest([event_type, json_extract_string(props, '$.k')]) AS tag FROM events) WHERE tag IS NOT NULL GROUP BY tag")
def tag_frequency(spark, d):
    tags = F.array("event_type", F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select(F.explode(tags).alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"))


@add("marker_document_frequency", "SELECT marker, sum(has)::bigint AS n, round(sum(has)::double / count(*), 6) AS share, sum(has)::double / count(*) > 0.55 AS warning FROM (" + " UNION ALL ".join(f"SELECT {S.q(m)} AS marker, contains(text, {S.q(m)})::int AS has FROM documents" for m in config.STYLE_TERMS) + ") GROUP BY marker")
def marker_document_frequency(spark, d):
    """One pass over the texts, then an unpivot of a single row."""
    t = F.col("text")
    one = docs(spark, d).agg(F.count("*").alias("all"), *[F.count_if(F.contains(t, F.lit(m))).alias(f"n{i}") for i, m in enumerate(config.STYLE_TERMS)])
    rows = one.select("all", F.inline(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"n{i}").alias("n")) for i, m in enumerate(config.STYLE_TERMS)])))
    share = F.col("n") / F.col("all")
    return rows.select("marker", "n", F.round(share, 6).alias("share"), (share > 0.55).alias("warning"))


@add("head_limit", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 20")
def head_limit(spark, d):
    """The first records by id, for a dry run: the limit is the feature."""
    return docs(spark, d).select("doc_id", "source").orderBy("doc_id").limit(20)


@add("one_to_one", "WITH p AS (SELECT DISTINCT lang, capability, source FROM " + PLACED + "), l AS (SELECT DISTINCT lang, source FROM p) SELECT 'lang' AS \"column\", lang AS value, count(*)::bigint AS others FROM l GROUP BY lang HAVING count(*) > 1 UNION ALL SELECT 'source', source, count(*) FROM l GROUP BY source HAVING count(*) > 1 UNION ALL SELECT 'capability', capability, count(DISTINCT lang) FROM p GROUP BY capability HAVING count(DISTINCT lang) > 1")
def one_to_one(spark, d):
    """Values that stand for more than one value of another column, both ways: lang and source do, capability does not."""
    p = placed(spark, d)
    return V.not_one_to_one(p, "lang", "source").unionByName(V.not_one_to_one(p, "lang", "capability"))
