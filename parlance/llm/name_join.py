"""Names within a small edit distance, by pigeonhole segments.

The distance is optimal string alignment: one code point inserted, deleted or replaced, or two neighbours
exchanged, none edited twice. An edit touches at most two pieces (an exchange may straddle two), so of
2 * most + 1 pieces at least one is untouched, and stands in the other name shifted by what the edits to its
left have inserted. Vendor names are cut into that many pieces; client names give, for each vendor length they can
reach and each piece number, the substrings at the shifts that the length difference leaves possible. The two meet
in an equi-join on (length, piece number, substring). Inside the join, two cheap bounds follow: a signature of the
characters (an edit changes at most two of its bits) and a Levenshtein distance of at most twice the edits (an
exchange is two). What is left is verified. Pairs that met in several pieces count once.

Vendor names with fewer code points than pieces can't be cut. They and the client names that can reach them are short,
and meet on what is left of them after up to `most` deletions.

Scale: equal names are one row with their count, smallest id and sum, so a name that a third of the clients has moves
as one row. Joins are sort-merge joins, whose large keys Spark splits; nothing is broadcast or collected.

Cases: names null or empty take no part. A null client_id counts, but is not the first and adds nothing to
clients_crc. A null vendor_id leaves the name as it is, and such rows make one group. Rows are taken as they
come: repeated clients, and repeated vendors, count as often. Very long names are cut like others. Empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

MOST = 2


def misspelt(name: Column, key: Column) -> Column:
    """Two neighbours exchanged where the key's crc32 is even and says where; shorter names, and those without a key, stay."""
    h, n = F.crc32(key.cast("string")), F.length(name)
    at = F.pmod(h, n - 1).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)), F.substring(name, at + 3, n))
    return F.when((F.pmod(h, F.lit(2)) == 0) & (n >= 2), swapped).otherwise(name)


def signature(name: str) -> Column:
    """64 bits: for each of 32 classes of characters whether there is one, and whether there are more. One edit changes
    two of them at most: it adds or takes one character, or both."""
    # what lies beyond 16 bits is one class, as split would halve it
    place, chars = "2 * pmod(ascii(c), 32)", rf"split(regexp_replace({name}, '[\\x{{10000}}-\\x{{10FFFF}}]', '?'), '')"
    return F.expr(f"aggregate({chars}, 0L, (bits, c) -> bits | shiftleft(1L, {place} + if(bits & shiftleft(1L, {place}) = 0, 0, 1)))")


def shifts(most: int, grown: int) -> list[int]:
    """Shifts of an untouched piece in a name that is `grown` longer: both sides' insertions are paid for."""
    return [s for s in range(-most, most + 1) if abs(s) + abs(grown - s) <= most]


def start(length: Column, piece: Column, pieces: int) -> Column:
    """Where a piece begins, from 0: the last pieces are one longer where the length is no multiple."""
    return F.floor(length / pieces).cast("int") * piece + F.greatest(F.lit(0), piece - (pieces - F.pmod(length, F.lit(pieces))))


def left_overs(name: Column, most: int) -> Column:
    """What is left after up to `most` deletions, each once."""
    drop = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(0), F.length(s) - 1), lambda i: F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, F.length(s))))).otherwise(F.array().cast("array<string>"))
    every = level = F.array(name)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, drop)))
        every = F.array_union(every, level)
    return every


def alignment(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Distances of pairs, exact up to `most` and above it where they are above; all pairs at once, along the diagonals that matter."""
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    width = int(max(la.max(initial=0), lb.max(initial=0)))
    code = []
    for x, lengths in ((a, la), (b, lb)):
        m = np.zeros((n, width + most + 2), np.int32)
        m[np.arange(m.shape[1]) < lengths[:, None]] = np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.int32)
        code.append(m)
    x, y = code
    far, band = most + 1, 2 * most + 1
    # row i holds the distances of the first i characters to the first i + k - most of the other
    before, now = np.full((n, band + 2), far), np.full((n, band + 2), far)
    for k in range(most, band):
        now[:, k + 1] = k - most
    result = np.where((la == 0) & (lb <= most), lb, far)
    for i in range(1, width + 1):
        row = np.full((n, band + 2), far)
        for k in range(band):
            j = i + k - most
            if j < 0 or j > width:
                continue
            best = now[:, k + 2] + 1
            if j:
                best = np.minimum(best, row[:, k] + 1)
                best = np.minimum(best, now[:, k + 1] + (x[:, i - 1] != y[:, j - 1]))
                if i > 1 and j > 1:
                    exchanged = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                    best = np.where(exchanged, np.minimum(best, before[:, k + 1] + 1), best)
            row[:, k + 1] = np.minimum(best, far)
        before, now = now, row
        at = lb - la + most
        ends = (la == i) & (at >= 0) & (at < band)
        result[ends] = now[ends, at[ends] + 1]
    return result


def verified(pairs: DataFrame, most: int) -> DataFrame:
    """pairs (vendor, client) within the distance, with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["vendor"].str.len() // 64):  # long names don't widen the tables of short ones
                d = alignment(list(part["vendor"]), list(part["client"]), most)
                yield part.assign(distance=d.astype(np.int32))[d <= most]

    return pairs.mapInPandas(run, "vendor string, client string, distance int")


def similar(vendors: DataFrame, clients: DataFrame, most: int = MOST) -> DataFrame:
    """vendors (name) and clients (name), different names each, to (vendor, client, distance), every pair once."""
    pieces = 2 * most + 1
    piece = F.col("piece")
    v = vendors.select(F.col("name").alias("vendor"), F.length("name").alias("size"), signature("name").alias("v_bits"))
    c = clients.select(F.col("name").alias("client"), F.length("name").alias("own"), signature("name").alias("c_bits"))

    begin = lambda size: start(size, piece, pieces)
    width = lambda size: start(size, piece + 1, pieces) - begin(size)
    cut = v.where(F.col("size") >= pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    cut = cut.select("vendor", "v_bits", "size", "piece", F.substring("vendor", begin(F.col("size")) + 1, width(F.col("size"))).alias("part"))
    ways = [(grown, p, s) for grown in range(-most, most + 1) for p in range(pieces) for s in shifts(most, grown)]
    way = F.explode(F.array(*[F.struct(F.lit(g).alias("grown"), F.lit(p).alias("piece"), F.lit(s).alias("shift")) for g, p, s in ways]))
    seen = c.withColumn("way", way).select("client", "c_bits", "own", (F.col("own") - F.col("way.grown")).alias("size"), "way.piece", "way.shift").where(F.col("size") >= pieces)
    seen = seen.withColumns({"at": begin(F.col("size")) + F.col("shift"), "width": width(F.col("size"))}).where("at >= 0 AND at + width <= own")
    seen = seen.select("client", "c_bits", "size", "piece", F.substring("client", F.col("at") + 1, F.col("width")).alias("part"))
    near = (F.bit_count(F.col("v_bits").bitwiseXOR(F.col("c_bits"))) <= 2 * most) & (F.levenshtein("vendor", "client", 2 * most) >= 0)
    met = _merged(cut, seen, ["size", "piece", "part"], near)

    few, may = v.where(F.col("size") < pieces), c.where(F.col("own") < pieces + most)
    rest = lambda x, name: x.select(name, F.explode(left_overs(F.col(name), most)).alias("part"))
    short = _merged(rest(few, "vendor"), rest(may, "client"), ["part"], F.lit(True))
    return verified(met.unionByName(short).distinct(), most)


def _merged(a: DataFrame, b: DataFrame, keys: list[str], also: Column) -> DataFrame:
    other = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[c for c in b.columns if c not in keys]).hint("merge")
    on = also
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    return a.join(other, on).select("vendor", "client")


def join(vendors: DataFrame, clients: DataFrame, stage: Stage, most: int = MOST) -> DataFrame:
    """vendors (vendor_id, name) and clients (client_id, name) to vendor_id, distance, n_clients, first_client_id, clients_crc."""
    own = stage.write(vendors.where("name <> ''").groupBy("vendor_id", "name").agg(F.count("*").alias("rows")))
    crc = F.coalesce(F.crc32(F.col("client_id").cast("string")), F.lit(0))
    held = stage.write(clients.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"), F.min("client_id").alias("first"), F.sum(crc).alias("crc")))
    pairs = similar(own.select("name").distinct(), held.select("name"), most)
    each = pairs.join(held.withColumnRenamed("name", "client").hint("merge"), "client")
    each = each.groupBy("vendor", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    out = own.withColumnRenamed("name", "vendor").join(each.hint("merge"), "vendor")
    return out.groupBy("vendor_id", "distance").agg(F.sum(F.col("n") * F.col("rows")).alias("n_clients"), F.min("first").alias("first_client_id"), F.sum(F.col("crc") * F.col("rows")).alias("clients_crc"))


def op12_name_join(spark, sf_dir: str) -> DataFrame:
    vendors = spark.read.parquet(f"{sf_dir}/vendors.parquet").select("vendor_id", misspelt(F.col("name"), F.col("vendor_id")).alias("name"))
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet").select("client_id", "name")
    return join(vendors, clients, Stage(spark, "op12"))
