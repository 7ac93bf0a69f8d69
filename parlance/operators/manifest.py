"""Manifests of tables of any size: digests that no order or partitioning changes, and a root over ranges of them.

A row's hash is the SHA-256 of its canonical JSON. Rows fall into 2**bits ranges by the first bits of their hash; each range has an
additive digest (functions/digest.py), and the root is a binary hash tree over the ranges' digests. Equal tables have equal
roots, whatever wrote them; where roots differ, the ranges that differ name about 1 / 2**bits of the rows each. Only the ranges' digests,
a number that `bits` fixes, are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digest as D
from ..functions.canonical import canonical_row
from .checks import ContractViolation

EMPTY = "0:0:0"


def range_digests(df: DataFrame, by: tuple[str, ...] = (), bits: int = 8) -> DataFrame:
    """(by, range, n, digest) for the ranges that have rows; by's columns are part of the rows as well."""
    if not 0 <= bits <= 16:
        raise ValueError("from 0 to 16 bits")
    sha = F.sha2(canonical_row(df), 256)
    own = df.select(*by, sha.alias("sha"))
    spot = F.shiftright(F.conv(F.substring("sha", 1, 4), 16, 10).cast("int"), 16 - bits)
    a, b = D.sums(F.col("sha"))
    each = own.groupBy(*by, spot.alias("range")).agg(F.count("*").alias("n"), a.alias("a"), b.alias("b"))
    return each.select(*by, "range", "n", D.rendered(F.col("n"), F.col("a"), F.col("b")).alias("digest"))


def manifest(df: DataFrame, by: tuple[str, ...] = (), bits: int = 8) -> DataFrame:
    """(by, n, root): one row per group; one row in all, of an empty table too, without groups."""
    ranges = range_digests(df, by, bits)
    held = F.map_from_entries(F.collect_list(F.struct("range", "digest")))
    each = ranges.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), held.alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(EMPTY)))
    # each level is bound once; written in place, a level would be worked out anew for every use of it
    x = each.select(*by, "n", F.transform(every, lambda v: F.sha2(v, 256)).alias("level"))
    for k in range(bits, 0, -1):
        pairs = F.sequence(F.lit(0), F.lit((1 << k - 1) - 1))
        x = x.select(*by, "n", F.transform(pairs, lambda i: F.sha2(F.concat(F.get("level", 2 * i), F.get("level", 2 * i + 1)), 256)).alias("level"))
    return x.select(*by, "n", F.get("level", 0).alias("root"))


def differing(left: DataFrame, right: DataFrame, bits: int = 8) -> DataFrame:
    """(range, n_left, n_right) where two tables differ."""
    a, b = range_digests(left, bits=bits), range_digests(right, bits=bits).select("range", F.col("n").alias("m"), F.col("digest").alias("other"))
    x = a.join(b, "range", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other")))
    return x.select("range", F.coalesce("n", F.lit(0)).alias("n_left"), F.coalesce("m", F.lit(0)).alias("n_right"))


def require_root(df: DataFrame, root: str, name: str = "table", bits: int = 8) -> None:
    """Fails where the table is not the one that the root was taken of."""
    found = manifest(df, bits=bits).first()
    if found.root != root:
        raise ContractViolation(f"{name}: root {found.root} of {found.n} rows, {root} is registered")
