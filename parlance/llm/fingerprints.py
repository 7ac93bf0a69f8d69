"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every 5-word shingle is hashed once: the top bits choose one of 512 bins, the rest compete for the bin's
minimum. An empty bin takes the value of the first full bin among bins drawn by a hash of its own number and
the attempt (Shrivastava 2017), the same draw in every document. Of each value the 4 low-order bits are kept,
256 bytes a document, written in base64. Likeness corrects the share of equal bins for the 1/16 that agree by
chance (Li and Koenig 2010).

Words are lower-cased (A-Z). A text of one to four words has the whole as its one shingle. A text without words
has an empty fingerprint; it is like another such (1) and unlike all else (0). Equal texts have equal fingerprints.

Order: documents descend by doc_id, nulls last, equal ids by text; the next of the last is the first. They are cut
into ranges of doc_id by quantiles, sorted within each, and streamed; each range also gets the first document
of the range that follows, so there is no global window. An empty table gives no rows, a single document is
its own next. Repeated rows follow each other. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, blocks, encoded, mix

SIZE, BINS, BITS = 5, 512, 4


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every shingle, repeats included."""
    w = Words([t.lower() for t in texts])
    doc, h = np.repeat(np.arange(len(texts)), w.count), w.hash
    m = max(0, len(h) - size + 1)
    s = np.zeros(m, U64)
    for j in range(size):
        s = mix(s * U64(0x9E3779B97F4A7C15) + h[j : m + j])
    whole = doc[:m] == doc[size - 1 :][:m]
    docs, hashes = [doc[:m][whole]], [s[whole]]
    for d in np.flatnonzero((w.count > 0) & (w.count < size)):
        x = np.zeros(1, U64)
        for v in h[w.first[d] : w.last[d]]:
            x = mix(x * U64(0xC2B2AE3D27D4EB4F) + v + U64(1))
        docs.append(np.array([d]))
        hashes.append(x)
    return np.concatenate(docs), np.concatenate(hashes)


def draws(bins: int, attempt: int) -> np.ndarray:
    """Where each bin looks for a value at an attempt."""
    return (mix(np.arange(bins, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64((attempt + 1) * 0xA0761D6478BD642F % (1 << 64))) % U64(bins)).astype(np.int64)


def fingerprints(texts: list[bytes], size: int = SIZE, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A row of `bins` low-order values per text, and whether the text has any shingle."""
    n = len(texts)
    doc, h = shingle_hashes(texts, size)
    full = U64(0xFFFFFFFFFFFFFFFF)
    low = np.full(n * bins, full, U64)
    shift = U64(64 - bins.bit_length() + 1)
    np.minimum.at(low, doc * bins + (h >> shift).astype(np.int64), h & ((U64(1) << shift) - U64(1)))
    low = low.reshape(n, bins)
    empty = low == full
    some = ~empty.all(axis=1)
    rows, cols = np.nonzero(empty & some[:, None])
    filled = low.copy()
    attempt = 0
    while len(rows):
        source = draws(bins, attempt)[cols]
        ok = ~empty[rows, source]
        filled[rows[ok], cols[ok]] = low[rows[ok], source[ok]]
        rows, cols = rows[~ok], cols[~ok]
        attempt += 1
    return (mix(filled) & U64((1 << bits) - 1)).astype(np.uint8), some


def pack(values: np.ndarray) -> list[str]:
    """Four-bit values, two a byte, in base64."""
    packed = (values[:, 0::2] << 4) | values[:, 1::2]
    return [base64.b64encode(x.tobytes()).decode() for x in packed]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    chance = 1 / (1 << bits)
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, est, np.where(some_a | some_b, 0.0, 1.0))


def edited(text: str, after: str) -> str:
    """text with its last third (rounded down) replaced by as many of the first characters of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (part, place): each with the row after it in its part; the guest that ends a part gives no row."""
    last = None
    for pdf in blocks(batches, "text", 400_000):
        pdf = pdf.assign(text=pdf["text"].fillna(""))
        if last is not None:
            pdf = pd.concat([last, pdf])
        texts, parts = list(pdf["text"]), pdf["part"].to_numpy()
        fp, some = fingerprints(encoded(texts))
        at = np.flatnonzero((parts[1:] == parts[:-1]) & ~pdf["guest"].to_numpy()[:-1])
        if len(at):
            changed = [edited(texts[i], texts[i + 1]) for i in at]
            raw = encoded(changed)
            efp, esome = fingerprints(raw)
            yield pd.DataFrame({
                "d": pdf["d"].to_numpy()[at], "n_chars": [len(texts[i]) for i in at], "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                "fingerprint": [x if y else "" for x, y in zip(pack(fp[at]), some[at], strict=True)], "edited_fingerprint": [x if y else "" for x, y in zip(pack(efp), esome, strict=True)],
                "near_edited": likeness(fp[at], efp, some[at], esome), "near_next": likeness(fp[at], fp[at + 1], some[at], some[at + 1]),
            })
        last = pdf.iloc[-1:]


def chain(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    least = -(1 << 63)  # stands for a null doc_id: it comes last in descending order
    own = docs.select(F.coalesce(docs["doc_id"], F.lit(least)).alias("d"), docs["text"].alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in own.approxQuantile("d", [i / n for i in range(1, n)], 0.2 / n) or []}) if n > 1 else []
    part = F.lit(0)
    if cuts:  # n - 1 numbers at most
        part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("d")))
    own = own.withColumn("part", part)
    # the first document of each part is the one with the largest id; it follows the part above, or, at the top, the bottom
    first = {r.part: r.d for r in own.groupBy("part").agg(F.max("d").alias("d")).collect()}  # n rows at most
    if not first:
        return docs.sparkSession.createDataFrame([], OUT)
    order = sorted(first, reverse=True)
    above = {order[(i + 1) % len(order)]: p for i, p in enumerate(order)}  # the part that a part's first document closes
    guest_of = F.create_map(*[F.lit(x) for p in order for x in (p, above[p])])
    is_first = F.create_map(*[F.lit(x) for p in order for x in (p, first[p])])
    guest = own.where(F.col("d") == is_first[F.col("part")]).select("d", "text", guest_of[F.col("part")].alias("part"), F.lit(True).alias("guest"))
    rows = own.withColumn("guest", F.lit(False)).unionByName(guest)
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "guest", F.desc("d"), "text")
    out = rows.mapInPandas(_chain, OUT.replace("doc_id", "d"))
    return out.withColumn("d", F.nullif("d", F.lit(least))).withColumnRenamed("d", "doc_id")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return chain(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
