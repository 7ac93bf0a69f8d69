"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Targets share the total size by weight. A source whose target passes `max_epochs` times its own size
stops there, and what it gives up is reshared by weight until no target is above its cap. A target of
r sizes takes every document floor(r) times; the fraction that is left takes one more copy of documents
in a seeded order, up to the fraction of the source's words.

Order and offsets: a source's documents are dealt into `slices` by a seeded hash, so that a source of any
size is summed and ordered in pieces; only one row per (source, slice) meets in the offsets.

Cases: null or empty texts have size 0 and take no words; they get the whole repetitions of their source and
no fractional one. Null is a source of its own, last in order. Repeated rows are documents of their own. An
empty table gives no rows. Extra columns, whatever their names, are carried along by `mix` and ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stage

WEIGHTS = (5.0, 2.0, 1.0)


def words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, stage: Stage, max_epochs: float = 3.0) -> DataFrame:
    """sources (source, source_size, weight) with target: least(cap, level * weight), sum of targets = sum of sizes.

    Each turn finds the level from the sources that are not at their cap yet; capped sources stay capped,
    so there are at most as many turns as sources, and each sends one row to the driver.
    """
    s = stage.write(sources.withColumn("cap", F.col("source_size") * max_epochs))
    level, capped = 0.0, -1
    while True:
        at = F.col("cap") <= level * F.col("weight")
        r = s.agg(
            F.count(F.when(at, 1)).alias("n"),
            F.sum("source_size").alias("total"),
            F.sum(F.when(at, F.col("cap")).otherwise(0.0)).alias("given"),
            F.sum(F.when(at, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if r.n == capped or not r.open:
            break
        capped, level = r.n, max(level, ((r.total or 0) - r.given) / r.open)
    return s.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def _plan(docs: DataFrame, stage: Stage, keep: list[str], weights: tuple[float, ...], max_epochs: float, seed: int, slices: int) -> DataFrame:
    """own (a struct of the kept columns k0, k1, ...), size, source_size, target, copies."""
    own = F.struct(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)])
    h = F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])
    sized = stage.write(docs.select(own.alias("own"), docs["source"].alias("source"), words(docs["text"]).alias("size"), h.alias("h")))
    sized = sized.withColumn("slice", F.pmod("h", F.lit(slices)))
    parts = stage.write(sized.groupBy("source", "slice").agg(F.sum("size").alias("part")))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    # one row per source; its position in code point order gives the weight
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    sources = whole.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    filled = water_fill(sources, stage, max_epochs)
    offsets = parts.withColumn("before", F.coalesce(F.sum("part").over(before), F.lit(0))).alias("p").join(filled.alias("f"), F.expr("p.source <=> f.source"))
    offsets = offsets.select(F.col("p.source").alias("s"), F.col("p.slice").alias("sl"), "before", "source_size", "target")
    x = sized.join(offsets, F.expr("source <=> s and slice = sl"))
    whole_reps = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    inside = Window.partitionBy("source", "slice").orderBy("h", "size", "own").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("reps", whole_reps).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    quota = F.col("target") - F.col("reps") * F.col("source_size")
    # the document across the quota's end goes in if most of it lies inside
    extra = F.when((F.col("size") > 0) & (F.col("at") + F.col("size") / 2 <= quota), 1).otherwise(0)
    return x.select("own", "size", "source_size", "target", (F.col("reps") + extra).cast("long").alias("copies"))


def plan(docs: DataFrame, stage: Stage, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = 3.0, seed: int = 17, slices: int = 512) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    x = _plan(docs, stage, ["doc_id"], weights, max_epochs, seed, slices)
    return x.select(F.col("own.k0").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, stage: Stage, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = 3.0, seed: int = 17, slices: int = 512) -> DataFrame:
    """The mixed documents: docs' own columns, each row as often as the plan takes it."""
    x = _plan(docs, stage, docs.columns, weights, max_epochs, seed, slices).where("copies > 0")
    return x.select("own", F.explode(F.expr("sequence(1L, copies)"))).select(*[F.col(f"own.k{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs, Stage(spark, "op1")).drop("copies")
