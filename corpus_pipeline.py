"""The corpus pipeline: documents through five stages, each written and read again as the next one's input.

Toxic documents go; one document of each group of near-duplicates stays; byte passages of 200 and more (fewer
than fifty words) that an earlier document has go; sources are mixed to target weights; what is left is segmented into sampled pieces. All stages but
the last return the columns of documents, with n_chars kept true to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import jaccard_join, mixing, pieces, suffix_array, toxicity
from parlance.llm.common import WORD, Stage
from parlance.llm.repeats import LAST, Spec

#: A passage of 51 words has 200 bytes and more in any but the tersest script.
PASSAGE = Spec(window=200, k=73, w=128, words=False)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. Learns from the labels of the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar ones (five-word shingles, similarity 0.8 or more).

    Rows of one doc_id, or of none, are told apart by their texts; rows that repeat both keep one row. Documents without
    words are similar to nothing, so all their rows stay.
    """
    stage = Stage(spark, "near")
    found = jaccard_join.join(docs, stage, size=5, percent=80)
    first = stage.write(found.where("n_shingles > 0 AND d = component AND rk = component_rk").select("d", "rk").distinct())
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    own = docs.where(worded).withColumns({"d": F.coalesce("doc_id", F.lit(LAST)), "rk": F.xxhash64("doc_id", "text")}).join(first, ["d", "rk"], "left_semi")
    one = Window.partitionBy("d", "rk").orderBy("source", "lang", "n_chars")
    kept = own.withColumn("row", F.row_number().over(one)).where("row = 1").select(*COLUMNS)
    return kept.unionByName(docs.where(~worded).select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes and more that a document with a smaller doc_id has, so that the first
    copy of each stays; characters cut in two are dropped. Null doc_ids come last. Rows of one doc_id are not earlier
    than one another. Empty and null texts stay as they are."""
    stage = Stage(spark, "passages")
    return suffix_array.cleaned(docs, stage, spec=PASSAGE, earlier=True).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.mix(docs.select(*COLUMNS), Stage(spark, "mixed"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_pieces, pieces_sha256, decoded_sha256, lossless."""
    return pieces.segment(docs, pieces.Pieces(), digest=True, carry=("source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("jaccard_join", near_duplicates),
    ("suffix_array", passages),
    ("mixing", mixed),
    ("sentencepiece", segmented),
]

#: The learned scores of the first stage are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for _, step in STAGES[:-1]:
        docs = stage.write(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
