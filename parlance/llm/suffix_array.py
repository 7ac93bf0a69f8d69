"""Substring dedup with a logarithmic family of suffix arrays over bytes.

A batch of documents gets a sparse suffix array: one entry for each sampled suffix (see repeats; the sampling
loses no 400-byte window), in the order of the fingerprints of its first 145 bytes and of its context. Any
total order that keeps equal prefixes together serves to find long matches. A new array is merge-scanned
against every level of the index for prefixes that both hold, and levels of equal rank merge, as in a binary
counter, so an entry is rewritten once per doubling. Prefixes that met are then verified on the bytes:
true lexicographic order and common prefix lengths of what follows and precedes them give the matches of
400 bytes and more.

Passages of over 50 words have fewer bytes than that where words are short. A family over 200-byte windows finds those first;
only documents whose repeated 200-byte windows are as many as one of 400 bytes holds go on to the second family.

Cases: null and empty texts have no bytes and lose none. Repeated rows are copies of one another, so all
their windows go. An empty table gives no rows; other columns are ignored. Removal may cut a character in
two: kept bytes are exact, and `kept_text` drops what is left of such characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, blocks, encoded
from .repeats import LAST, MOST, Spec, anchor_rows, covered, entries, groups, keyed, meeting, runs, spans

WINDOW = Spec(window=400, k=145, w=256, words=False)
#: A passage of 51 words has 200 bytes and more in any but the tersest script.
PASSAGE = Spec(window=200, k=73, w=128, words=False)


class LogIndex:
    """Levels of suffix arrays, as written tables (kh, ch, n); the level of rank r holds 2**r batches.

    What a batch's array meets in itself and in the levels is all that `matches` knows: suffixes of a level that
    was not scanned are not found."""

    def __init__(self, stage: Stage):
        self.stage = stage
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """batch: sampled suffixes (kh, ch) of new documents. Notes the prefixes that occur again, in it or in a level, then files it."""
        array = self.stage.write(batch.groupBy("kh", "ch").agg(F.count("*").alias("n")).sortWithinPartitions("kh", "ch"))
        own = array.groupBy("kh").agg(F.sum("n").alias("n"))
        met = own.where("n >= 2").select("kh")
        for _, level in self.levels:
            met = met.unionByName(own.select("kh").join(level.select("kh"), "kh", "left_semi"))
        self.met.append(self.stage.write(met.distinct()))
        rank = 0
        old = []
        while self.levels and self.levels[-1][0] == rank:
            old.append(self.levels.pop()[1])
            rank += 1
        if old:
            merged = array
            for level in old:
                merged = merged.unionByName(level)
            level = self.stage.write(merged.groupBy("kh", "ch").agg(F.sum("n").alias("n")).sortWithinPartitions("kh", "ch"))
            self.stage.drop(array, *old)
            array = level
        self.stage.free()
        self.levels.append((rank, array))

    def matches(self) -> DataFrame:
        """The prefixes that met."""
        out = self.met[0]
        for f in self.met[1:]:
            out = out.unionByName(f)
        return out.distinct()

    def close(self) -> None:
        self.stage.drop(*[level for _, level in self.levels])


def repeated(own: DataFrame, stage: Stage, spec: Spec, batches: int = 4, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The anchors of keyed documents whose prefixes occur again, and the offsets of the windows that do."""
    a = stage.write(anchor_rows(own, spec))
    index = LogIndex(stage)
    for b in range(batches):
        index.add(a.where(F.pmod("rk", F.lit(batches)) == b).select("kh", "ch"))
    index.close()
    a = meeting(stage, a, index.matches())
    found = stage.write(groups(entries(a)))
    return a, runs(stage, own, found, spec, most)


def ranges(own: DataFrame, stage: Stage, spec: Spec = WINDOW, batches: int = 4, most: int = MOST, earlier: bool = False) -> DataFrame:
    """keyed documents to d, rk, spans: the byte ranges of windows that start anywhere else too, where there are any;
    earlier: only of windows that a document with a smaller doc_id has."""
    return spans(*repeated(own, stage, spec, batches, most), spec, earlier)


def dedup(docs: DataFrame, stage: Stage, **options) -> DataFrame:
    """d, text, spans: each document with the byte ranges to remove."""
    own = keyed(docs)
    return own.join(ranges(own, stage, **options).hint("shuffle_hash"), ["d", "rk"], "left").select("d", "text", "spans")


def with_passages(docs: DataFrame, stage: Stage, spec: Spec = WINDOW, short: Spec = PASSAGE, **options) -> DataFrame:
    """d, text, spans, passages: as dedup, with the byte ranges of short windows that a document with a smaller doc_id has.

    Where a window occurs, all short windows in it do, so a document with fewer repeated short ones has no range to remove."""
    own = keyed(docs)
    a, again = repeated(own, stage, short, **options)
    x = a.join(again, ["kh", "ch"]).select("d", "rk", "first", (F.col("p") - F.col("s_hi")).alias("a"), (F.col("p") - F.col("s_lo") + short.window).alias("b"))
    earlier = F.collect_list(F.when(F.col("first") < F.col("d"), F.struct("a", "b")))
    per_doc = stage.write(x.groupBy("d", "rk").agg(earlier.alias("passages"), F.sum(F.col("b") - F.col("a") - short.window + 1).alias("starts")))
    stage.drop(a, again)
    long = per_doc.where(F.col("starts") > spec.window - short.window).select("d", "rk")
    found = ranges(stage.write(own.join(long.hint("shuffle_hash"), ["d", "rk"], "left_semi")), stage, spec, **options)
    out = own.join(found.hint("shuffle_hash"), ["d", "rk"], "left").join(per_doc.hint("shuffle_hash"), ["d", "rk"], "left")
    return out.select("d", "text", "spans", "passages")


def remove(raw: bytes, found) -> tuple[bytes, int, int]:
    """What is left of raw, the number of bytes removed, and of maximal removed runs."""
    if found is None or not len(found):
        return raw, 0, 0
    drop = covered(len(raw), found)
    rest = np.frombuffer(raw, np.uint8)[~drop].tobytes()
    return rest, int(drop.sum()), int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())


def kept(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256; with passages also n_passage_bytes, the bytes that those cover."""
    more = "passages" in found.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text", 4_000_000):
            rows = []
            for raw, at in zip(encoded(pdf["text"]), pdf["spans"], strict=True):
                rest, gone, n = remove(raw, at)
                rows.append((len(raw), gone, n, rest, hashlib.sha256(rest).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
            out.insert(0, "d", pdf["d"].array)
            if more:
                out["n_passage_bytes"] = [int(covered(n, at).sum()) for n, at in zip(out["n_bytes"], pdf["passages"], strict=True)]
            yield out

    out = found.mapInPandas(run, "d long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string" + ", n_passage_bytes long" * more)
    return out.withColumn("d", F.nullif("d", F.lit(LAST))).withColumnRenamed("d", "doc_id")


def cleaned(docs: DataFrame, stage: Stage, **options) -> DataFrame:
    """docs with text as it is after removal and n_chars its length; doc_id, lang and source as they were.

    Only the repeated passages' ranges meet the documents; untouched texts, null ones among them, stay as they are.
    """

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if at is None or not len(at) else remove(encoded([t])[0], at)[0].decode("utf-8", "ignore") for t, at in zip(texts, spans, strict=True)], dtype=object)

    found = ranges(keyed(docs), stage, **options)
    own = docs.withColumn("d", F.coalesce(docs["doc_id"], F.lit(LAST))).withColumn("rk", F.xxhash64(docs["doc_id"], docs["text"]))
    out = own.join(found.hint("shuffle_hash"), ["d", "rk"], "left").withColumn("text", F.pandas_udf(cut, "string")("text", "spans"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kept(with_passages(docs, Stage(spark, "op7"))).drop("kept")
