"""Queries on texts: normal forms, counts, rule metrics and their roll-ups, over documents as responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import metrics as M
from ..functions import text as X
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


CAPABILITY = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.CAPABILITIES.items()) + " END"


def responses(spark, d: str) -> DataFrame:
    """documents as responses: a capability from the language, a seriousness 1..5 from the id, a reference answer and its bigrams, listed once for each item."""
    docs = table(spark, d, "documents").withColumn("capability", X.mapped(F.col("lang"), config.CAPABILITIES)).withColumn("serious", (F.pmod("doc_id", F.lit(5)) + 1).cast("long"))
    gold = table(spark, d, "benchmark").select(F.col("item_id").alias("gold_id"), F.col("text").alias("gold"), X.char_ngrams(F.col("text"), 2).alias("gold_grams"))
    return docs.join(gold, F.pmod("doc_id", F.lit(40)) == F.col("gold_id"), "left")


RESPONSES = f"(SELECT d.*, {CAPABILITY} AS capability, doc_id % 5 + 1 AS serious, b.text AS gold FROM documents d LEFT JOIN benchmark b ON d.doc_id % 40 = b.item_id)"


def simple(name: str, col: Callable[[], Column], sql: str) -> None:
    """One value per document, from its text. Columns are made when the query runs: only then need Spark be there."""
    QUERIES[name] = lambda spark, d, col=col: table(spark, d, "documents").select("doc_id", col().alias("value"))
    SQL[name] = f"SELECT doc_id, {sql} AS value FROM documents"


def t() -> Column:
    return F.col("text")


simple("text_normalize_hash", lambda: X.text_hash(X.normalized(t())), f"sha256({S.normalized('text')})")
simple("visible_length", lambda: X.visible_length(t()), f"({S.visible('text')})::bigint")
simple("stable_item_seed", lambda: X.stable_seed(F.lit("7"), F.col("doc_id").cast("string"), F.col("source")), S.seed("'7'", "doc_id::varchar", "source"))
simple("composite_id", lambda: F.format_string("%s:%s:T%02d", F.col("lang"), F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(7))), "lang || ':' || doc_id::varchar || ':T' || lpad((doc_id % 7)::varchar, 2, '0')")
simple("sentence_stats", lambda: F.to_json(X.sentence_lengths(t())), f"to_json({S.sentences('text')})::varchar")
simple("term_counts", lambda: X.terms_total(t(), config.STYLE_TERMS), f"({S.total('text', config.STYLE_TERMS)})::bigint")
simple("bigram_set_size", lambda: F.size(X.char_ngrams(t(), 2)).cast("long"), f"len({S.ngrams('text', 2)})::bigint")
simple("forbidden_phrase", lambda: X.any_term(t(), config.FORBIDDEN_PHRASES), S.any_of("text", config.FORBIDDEN_PHRASES))
simple("enum_remap", lambda: F.coalesce(X.mapped(F.col("lang"), config.CAPABILITIES), F.lit("unknown")), f"coalesce({CAPABILITY}, 'unknown')")

EXCLUSIVE = S.exclusive("text", config.STYLE_TERMS)


@add("marker_counts_exclusive", "SELECT doc_id, " + ", ".join(f"({e})::bigint AS m_{k}" for k, e in EXCLUSIVE.items()) + " FROM documents")
def marker_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(f"m_{k}") for k, c in X.exclusive_counts(t(), config.STYLE_TERMS).items()])


POLAR = ("stupid", "tion", "ung")


@add("polarity_counts", "SELECT doc_id, " + ", ".join(f"{S.affirmed('text', k)}::bigint AS yes_{k}, {S.negated('text', k)}::bigint AS no_{k}" for k in POLAR) + " FROM documents")
def polarity_counts(spark, d):
    own = table(spark, d, "documents").select("doc_id", *[X.polarity(t(), k).alias(k) for k in POLAR])
    return own.select("doc_id", *[F.col(f"{k}.affirmed").alias(f"yes_{k}") for k in POLAR], *[F.col(f"{k}.negated").alias(f"no_{k}") for k in POLAR])


@add("ngram_overlap", f"SELECT doc_id, round(len(list_intersect({S.ngrams('text', 2)}, {S.ngrams('gold', 2)}))::double / greatest(1, len({S.ngrams('gold', 2)})), 6) AS coverage FROM {RESPONSES} WHERE gold IS NOT NULL")
def ngram_overlap(spark, d):
    r = F.col("gold_grams")
    return responses(spark, d).where("gold IS NOT NULL").select("doc_id", F.round(X.grams_held(t(), r, 2) / F.greatest(F.lit(1), F.size(r)), 6).alias("coverage"))


@add("constraint_status", "SELECT doc_id, " + ", ".join(f"{S.status('text', 'text', f)} AS {f}" for f in config.FACTS) + " FROM documents")
def constraint_status(spark, d):
    return table(spark, d, "documents").select("doc_id", *[X.fact_status(t(), t(), f).alias(f) for f in config.FACTS])


#: Made when a query asks for one: a metric is some hundred expressions, and each is built through the gateway.
METRICS: dict[str, Callable[[], Column]] = {
    "style_marker": lambda: M.style_marker(t(), F.col("serious"), F.col("seen")), "register_match": lambda: M.register_match(t(), F.col("serious"), F.col("seen")),
    "factual_support": lambda: M.factual_support(t(), F.col("gold"), t(), F.col("gold_grams"), F.col("facts"), F.col("seen")), "constraints": lambda: M.constraints(t(), t(), F.col("facts")),
    "principle_coverage": lambda: M.principle_coverage(t(), F.col("capability"), F.col("seen")), "conflict_safety": lambda: M.conflict_safety(t(), F.col("serious"), t()),
}


def measured(df: DataFrame, names) -> DataFrame:
    """Responses with metrics. What several of them ask for, the text without white space and its facts, is found once."""
    df = df.withColumns({"seen": X.unspaced(t()), "facts": M.fact_counts(t(), t())})
    return df.withColumns({m: METRICS[m]() for m in names}).drop("seen", "facts")


METRICS_SQL = {"style_marker": S.style_marker("text", "serious"), "register_match": S.register("text", "serious"), "factual_support": S.factual("text", "gold", "text"), "constraints": S.constraint("text", "text"), "principle_coverage": S.principle("text", "capability"), "conflict_safety": S.conflict("text", "serious", "text")}
for _m in METRICS_SQL:
    QUERIES[f"{_m}_score"] = lambda spark, d, m=_m: measured(responses(spark, d), [m]).select("doc_id", F.col(m).alias("score"))
    SQL[f"{_m}_score"] = f"SELECT doc_id, {METRICS_SQL[_m]} AS score FROM {RESPONSES}"

SCORED_SQL = "(SELECT doc_id, lang, capability, source, " + ", ".join(f"{e} AS {m}" for m, e in METRICS_SQL.items()) + f" FROM {RESPONSES})"
LAYERS_SQL = {layer: "round(" + " + ".join(f"{w}::double * {m}" for m, w in ws.items()) + " + 1e-9::double, 4)" for layer, ws in config.METRIC_WEIGHTS.items()}
LAYERED_SQL = f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in LAYERS_SQL.items())} FROM {SCORED_SQL})"
OVERALL_SQL = "round(" + " + ".join(f"{w}::double * {k}" for k, w in config.LAYER_WEIGHTS.items()) + " + 1e-9::double, 4)"


def scored(spark, d) -> DataFrame:
    """All metrics of a response in one pass, then its layers and overall score."""
    own = measured(responses(spark, d), METRICS).select("doc_id", "lang", "capability", "source", *METRICS)
    return own.withColumns({k: c for k, c in M.layers({m: F.col(m) for m in METRICS_SQL}).items() if k != "overall"}).withColumn("overall", M.rounded(sum((F.lit(w) * F.col(k) for k, w in config.LAYER_WEIGHTS.items()), F.lit(0.0))))


@add("layer_scores", f"SELECT doc_id, {', '.join(LAYERS_SQL)}, {OVERALL_SQL} AS overall FROM {LAYERED_SQL}")
def layer_scores(spark, d):
    return scored(spark, d).select("doc_id", *LAYERS_SQL, "overall")


@add("overall_by_capability", f"SELECT capability, count(*)::bigint AS n, round(avg(overall) + 1e-9::double, 4) AS overall FROM (SELECT *, {OVERALL_SQL} AS overall FROM {LAYERED_SQL}) GROUP BY capability")
def overall_by_capability(spark, d):
    return scored(spark, d).groupBy("capability").agg(F.count("*").alias("n"), M.rounded(F.avg("overall")).alias("overall"))


@add("seriousness_ladder", """SELECT user_id, CASE WHEN list_has_any(list(event_type), ['purchase', 'error']) THEN 5 WHEN list_has_any(list(event_type), ['signup']) THEN 4 WHEN list_has_any(list(event_type), ['click']) THEN 3 ELSE 2 END AS seriousness,
    CASE WHEN list_contains(list(event_type), 'purchase') THEN 'direct' WHEN list_contains(list(event_type), 'click') THEN 'oblique' ELSE 'none' END AS topic_mode,
    array_to_string(list_sort(list_distinct(list_filter(list(event_type), lambda x: x IN ('click', 'view')))), ',') AS allowed FROM events GROUP BY user_id""")
def seriousness_ladder(spark, d):
    """Priority by overlap of tag sets, first-match classification, and an allow-list of tags."""
    tags = F.col("tags")
    has = lambda *x: F.arrays_overlap(tags, F.array(*map(F.lit, x)))
    own = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return own.select(
        "user_id",
        F.when(has("purchase", "error"), 5).when(has("signup"), 4).when(has("click"), 3).otherwise(2).alias("seriousness"),
        F.when(has("purchase"), "direct").when(has("click"), "oblique").otherwise("none").alias("topic_mode"),
        F.array_join(F.array_sort(F.filter(tags, lambda x: x.isin("click", "view"))), ",").alias("allowed"),
    )
