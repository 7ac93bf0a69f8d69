"""Substring dedup with prefix-partitioned suffix trees over words.

Suffixes are grouped by a prefix of 19 words; groups whose tree would not fit a bound in bytes get prefixes of 43, 49 and at
last 50 words, a window, as far as each needs it. The subtree of a group gives the nodes at least 50 words deep, which are the repeats
(see repeats). Sampled suffixes stand for all windows without loss.

Words are compared by 64-bit hashes, and contexts by two of them; kept words and texts are the documents' own.

Cases: null and empty texts have no words and lose none. A null doc_id comes after all others. Repeated rows
share a doc_id, so neither precedes the other; rows with one doc_id but different texts are told apart.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, blocks, encoded
from .repeats import LAST, MOST, Spec, anchor_rows, covered, entries, groups, keyed, meeting, runs, spans

WINDOW = Spec(window=50, k=19, w=32, words=True)


def dedup(docs: DataFrame, stage: Stage, spec: Spec = WINDOW, most: int = MOST) -> DataFrame:
    """d, text, spans: each document with the word ranges that an earlier document's windows cover."""
    own = keyed(docs)
    a = stage.write(anchor_rows(own, spec))
    a = meeting(stage, a, a.groupBy("kh").count().where("count > 1").select("kh"))
    found = stage.write(groups(entries(a)))
    repeated = runs(stage, own, found, spec, most)
    got = spans(a, repeated, spec, earlier=True)
    return own.join(got.hint("shuffle_hash"), ["d", "rk"], "left").select("d", "text", "spans")


def kept(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: words joined by one space), kept_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text", 4_000_000):
            rows = []
            for raw, at in zip(encoded(pdf["text"]), pdf["spans"], strict=True):
                words = raw.split()
                gone = 0
                if at is not None and len(at):
                    drop = covered(len(words), at)
                    gone = int(drop.sum())
                    rest = b" ".join([w for w, x in zip(words, drop.tolist(), strict=True) if not x])
                else:
                    rest = b" ".join(words)
                rows.append((len(words), gone, rest, hashlib.sha256(rest).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "kept_sha256"])
            out.insert(0, "d", pdf["d"].array)
            yield out

    out = found.mapInPandas(run, "d long, n_words long, n_removed long, kept binary, kept_sha256 string")
    return out.withColumn("d", F.nullif("d", F.lit(LAST))).withColumnRenamed("d", "doc_id")


def op2_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return kept(dedup(docs, Stage(spark, "op2"))).drop("kept")
