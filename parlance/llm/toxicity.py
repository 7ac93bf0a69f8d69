"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: presence of single words, word beginnings, pairs of neighbours and pairs with one word between them,
lower-cased (A-Z), ASCII punctuation cut off, hashed to 2**22 slots. FTRL-proximal keeps a learning rate per slot and
sets to zero what L1 allows, so the weights that stay are few. Should they be more than `max_weights` (about 2 MB),
L1 is raised until they are not, which bounds the broadcast whatever the input.

Fit: the labelled rows that count are put in the order of a seeded hash, and the first `max_rows` are learned in
that order by one task; the bound holds at every input size.

Cases: null and empty texts have no features; their score is that of the bias. Null labels teach nothing. Repeated
rows are learned as often as they occur, in a stable order. With no label at all, the score is 0.5 - every text
is kept. Extra columns are ignored; the score uses the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, Words, blocks, byte_symbols, encoded, mix

SLOTS = 22
#: Bytes of the word beginnings that count as features beside whole words: vocabularies with many endings repeat these.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every different feature of each text."""
    w = Words([_plain(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), w.count)
    h = w.hash
    parts, docs = [h], [doc]
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        parts.append(mix(h[:-gap] * U64(odd) + h[gap:])[same])
        docs.append(doc[gap:][same])
    roll = Rolling(byte_symbols(w.raw)) if len(h) else None
    for size in STEMS:
        long = np.flatnonzero(w.end - w.start > size)
        if len(long):
            parts.append(mix(roll.of(w.start[long], w.start[long] + size) + U64(size)))
            docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(parts) >> U64(64 - SLOTS)).astype(np.int64)


#: ASCII punctuation becomes white space, and A-Z lower case; bytes of other characters stay.
_PLAIN = bytes(32 if (chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _plain(raw: bytes) -> bytes:
    return raw.translate(_PLAIN)


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss (McMahan et al. 2013)."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << SLOTS), np.zeros(1 << SLOTS)
        self.bias_z, self.bias_n = 0.0, 0.0

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def restrict(self, most: int) -> None:
        """Raises L1 to the least value that leaves `most` weights or fewer."""
        size = np.abs(self.z)
        if np.count_nonzero(size > self.l1) > most:
            self.l1 = float(np.partition(size, len(size) - most - 1)[len(size) - most - 1])

    def learn(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        b = self.bias()
        g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35))) - label
        for_n = self.n[slots]
        self.z[slots] += g - (np.sqrt(for_n + g * g) - np.sqrt(for_n)) / self.alpha * w
        self.n[slots] = for_n + g * g
        step = (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha
        self.bias_z += g - step * b
        self.bias_n += g * g


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, epochs: int = 4, max_weights: int = 1 << 17, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """docs (doc_id, text) and labels (doc_id, label 0/1) to slots, weights and bias; learns from max_rows at most.

    The sample is drawn from the labels alone, so texts that are not in it never move; max_rows bounds the broadcast.
    """
    drawn = labels.select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64(F.lit(seed), "doc_id").alias("h")).where("label IN (0, 1)")
    drawn = F.broadcast(drawn.orderBy("h", "label").limit(max_rows))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select("text", "label", "h")
    rows = rows.repartition(1).sortWithinPartitions("h", "label", "text")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[tuple[np.ndarray, int]] = []
        for pdf in blocks(batches, "text", 1_000_000):
            doc, slot = features(encoded(pdf["text"]))
            key = np.unique((doc << SLOTS) | slot)
            at = np.searchsorted(key >> SLOTS, np.arange(len(pdf) + 1))
            slots = (key & ((1 << SLOTS) - 1)).astype(np.int32)
            if len(seen) >= max_rows:  # repeated rows of a document
                continue
            seen += [(slots[at[i] : at[i + 1]], int(y)) for i, y in enumerate(pdf["label"])]
        model = Ftrl()
        for _ in range(epochs):
            for slots, y in seen:
                model.learn(slots, y)
        model.restrict(max_weights)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.append(at, -1), "weight": np.append(w[at], model.bias())})

    got = rows.mapInPandas(learn, "slot long, weight double").toPandas()
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    got = got.sort_values("slot")
    return got["slot"].to_numpy()[1:], got["weight"].to_numpy()[1:], float(got["weight"].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], carry: list[str]) -> DataFrame:
    """carry's columns of docs (text among them) and score, 0 to 1."""
    own = docs.select(F.struct(*[docs[c].alias(f"k{i}") for i, c in enumerate(carry)]).alias("own"), docs["text"].alias("text"))
    slots, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((slots.astype(np.int32), weights.astype(np.float32), bias))

    def scores(texts: list[bytes]) -> np.ndarray:
        slots, weights, bias = sent.value
        table = np.zeros(1 << SLOTS, np.float32)
        table[slots] = weights
        doc, slot = features(texts)
        hit = np.flatnonzero(table[slot])
        key = np.unique((doc[hit] << SLOTS) | slot[hit])  # each feature counts once
        total = np.bincount(key >> SLOTS, table[key & ((1 << SLOTS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [scores(encoded(b["text"])) for b in blocks([texts.to_frame("text")], "text", 1_000_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    out = own.withColumn("score", scored("text"))
    return out.select(*[F.col(f"own.k{i}").alias(c) for i, c in enumerate(carry)], "score")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    seen = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    model = fit(docs, seen)
    out = score(docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
