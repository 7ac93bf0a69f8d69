"""Similarity self-join of documents on the Jaccard coefficient of word n-gram sets, with adaptive multi-match prefixes.

A document's shingles are put in an order that has the rare first (by counts over all documents in a table of
fixed size, then by hash; any total order is right, a rare-first one is fast). For a threshold t, sets x and y
that link share l tokens of their prefixes of |x| - ceil(t|x|) + l and |y| - ceil(t|y|) + l tokens. A longer
prefix costs more postings but asks for more shared tokens; each document takes the l in 1..`most` whose estimated
cost of postings and verifications is least, and a pair is a candidate when its prefixes share the smaller l and
so many that, with all that may be shared behind them, the threshold can be met.

Equal sets are one node. Only components are wanted, so a posting list is never expanded into all its pairs. First
every node is verified against one hub of a list it is in, the member that has most of its prefix in common with
others; nodes that are in one component already need no more pairs among them. Then every node outside its
list's largest component is verified against its likeliest partner; then all pairs of different components that
can still reach the threshold are. The last two rounds compare the nodes of a list by bitmaps of their sets: as
many bits as differ are tokens in one set only, which bounds from above what two sets share. A pair is left out only where that bound, sizes or places show that it can't
link, so the components are exact. Lists of more than `block` nodes are compared in pairs of blocks, each a group
of its own. Verification counts shingles (64-bit hashes) of both whole sets.

Cases: without words or text a set is empty and linked with nothing, its component being its own doc_id. One
or two words are one shingle. Null doc_ids count as after all others (component_id null if no other is in it).
Repeated rows have equal sets. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Stage, Words, blocks, components, encoded, mix
from .repeats import LAST, keyed

BITS = 18  # the counts are 2**BITS numbers, whatever the input


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after the other, each sorted, and where each ends."""
    w = Words([t.lower() for t in texts])
    n = len(texts)
    doc, h = np.repeat(np.arange(n), w.count), w.hash
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, U64)
        for j in range(size):
            s = mix(s * U64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j])
        whole = doc[: len(s)] == doc[size - 1 :]
        doc_s, s = doc[: len(s)][whole], s[whole]
    else:
        doc_s, s = doc[:0], h[:0]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i, d in enumerate(short):
            for x in h[w.first[d] : w.last[d]]:
                extra[i : i + 1] = mix(extra[i : i + 1] * U64(0xC2B2AE3D27D4EB4F) + x + U64(1))
        doc_s, s = np.concatenate((doc_s, short)), np.concatenate((s, extra))
    order = np.lexsort((s, doc_s))
    doc_s, s = doc_s[order], s[order]
    if len(s):
        new = np.concatenate(([True], (doc_s[1:] != doc_s[:-1]) | (s[1:] != s[:-1])))
        doc_s, s = doc_s[new], s[new]
    return s, np.cumsum(np.bincount(doc_s, minlength=n))


def _measure(size: int):
    """Per document d, rk, key (hash of the set) and n; and, when the task ends, its shingle counts in slices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << BITS, np.int64)
        for pdf in blocks(batches, "text", 1_500_000):
            s, end = shingle_sets(encoded(pdf["text"]), size)
            counts += np.bincount((s >> U64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
            n = np.diff(end, prepend=0)
            yield pd.DataFrame({"d": pdf["d"].to_numpy(), "rk": pdf["rk"].to_numpy(), "key": _keys(s, end, n), "n": n, "slice": np.int32(-1), "counts": None})
        part = counts.reshape(256, -1).astype("<i8")
        yield pd.DataFrame({"d": 0, "rk": 0, "key": 0, "n": 0, "slice": np.arange(256, dtype=np.int32), "counts": [x.tobytes() for x in part]})

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in pdf["counts"])
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "lot": [0], "counts": [total.tobytes()]})


FLOOR = 4  # the fewest shared tokens asked of sets that have so many


def _postings(size: int, percent: int, most: int, sent):
    """tok, key, n, need, at, rest: the prefix of each document, as long as its estimated costs advise; at is the token's
    place in the order, rest the number of tokens behind the prefix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, total_docs = sent.value
        floor = counts.mean()
        for pdf in blocks(batches, "text", 1_500_000):
            s, end = shingle_sets(encoded(pdf["text"]), size)
            n = np.diff(end, prepend=0)
            doc = np.repeat(np.arange(len(n)), n)
            seen = counts[(s >> U64(64 - BITS)).astype(np.int64)]
            order = np.lexsort((s, seen, doc))
            s, seen = s[order], np.maximum(seen[order] - floor, 1.0)
            place = np.arange(len(s)) - np.repeat(end - n, n)
            least = -(-percent * n // 100)
            total = np.concatenate(([0.0], np.cumsum(seen)))
            cost = np.full((most, len(n)), np.inf)
            for need in range(1, most + 1):
                reach = np.minimum(n, n - least + need)
                scan = total[end - n + reach] - total[end - n]
                # a document at random shares scan / total_docs tokens on average, and `need` by Poisson's law
                chance = (scan / total_docs) ** need / math.factorial(need)
                ok = (n > 0) & (need >= np.minimum(FLOOR, least)) & (need <= least)
                cost[need - 1, ok] = (scan + reach + n * total_docs * np.minimum(chance, 1))[ok]
            need = cost.argmin(axis=0) + 1
            reach = np.minimum(n, n - least + need)
            at = np.flatnonzero(place < np.repeat(reach, n))
            d = doc[at]
            yield pd.DataFrame({"tok": s[at].view(np.int64), "key": _keys(s, end, n)[d], "n": n[d].astype(np.int32), "need": need[d].astype(np.int8), "at": place[at].astype(np.int32), "rest": (n - reach)[d].astype(np.int32)})

    return run


def _keys(s: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set: its sum does not depend on the order of the shingles."""
    sums = np.zeros(len(s) + 1, U64)
    np.cumsum(mix(s ^ U64(0xA0761D6478BD642F)), out=sums[1:])
    return mix(sums[end] - sums[end - n] + n.astype(U64) * U64(0xE7037ED1A0B428DB)).view(np.int64)


BITMAP = 512


def bitmaps(s: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Of each set, the parity of its tokens by their hash, in BITMAP bits: every posting carries them."""
    many = len(end)
    at = np.repeat(np.arange(many) * BITMAP, np.diff(end, prepend=0)) + (mix(s ^ U64(0x8EBC6AF09C88C6E3)) % U64(BITMAP)).astype(np.int64)
    odd = (np.bincount(at, minlength=many * BITMAP) & 1).astype(np.uint8)
    raw = np.packbits(odd, bitorder="little").tobytes()
    return [raw[i : i + BITMAP // 8] for i in range(0, len(raw), BITMAP // 8)]


def apart(maps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number of tokens that are in one only of the sets i and j."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 50_000):
        out[a : a + 50_000] = np.bitwise_count(maps[i[a : a + 50_000]] ^ maps[j[a : a + 50_000]]).sum(axis=1)
    return out


def _packed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for pdf in blocks(batches, "text", 1_500_000):
        texts = encoded(pdf["text"])
        yield pd.DataFrame({"key": pdf["key"].to_numpy(), "packed": [pack.compress(t) for t in texts], "bits": bitmaps(*shingle_sets(texts, size))})


def met_in(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of different components in whole (tok, slot) groups of sorted rows that can link: positions i, j, least number of tokens in one only."""
    tok, slot = pdf["tok"].to_numpy(), pdf["slot"].to_numpy()
    n, at, can, rest, comp, key = (pdf[c].to_numpy(np.int64) for c in ("n", "at", "can", "rest", "comp", "key"))
    turn = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (slot[1:] != slot[:-1]))))
    stop = np.append(turn[1:], len(tok))
    group = np.repeat(np.arange(len(turn)), stop - turn)
    left, right = np.flatnonzero(pdf["x"].to_numpy(bool)), np.flatnonzero(pdf["y"].to_numpy(bool))
    first = np.searchsorted(group[right], np.arange(len(turn)))
    many = np.bincount(group[right], minlength=len(turn))[group[left]]
    maps = np.frombuffer(b"".join(pdf["bits"]), "<u8").reshape(len(pdf), -1)
    minor = comp != pdf["major"].to_numpy(np.int64)
    found = []
    ends = np.cumsum(many)
    s = 0
    while s < len(left):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 1_000_000, "right")))
        i = np.repeat(left[s:e], many[s:e])
        back = ends[s:e] - many[s:e]
        j = right[np.repeat(first[group[left[s:e]]], many[s:e]) + np.arange(len(i)) - np.repeat(back - back[0], many[s:e])]
        ok = (comp[i] != comp[j]) & (~minor[j] | (key[i] < key[j]))
        i, j = i[ok], j[ok]
        behind = np.maximum(rest[i], rest[j])
        sizes = n[i] + n[j]
        most = np.minimum(np.minimum(n[i], n[j]), np.minimum(can[i], can[j]) + behind)
        most = np.minimum(most, np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]))
        ok = most * (100 + percent) >= sizes * percent
        i, j = i[ok], j[ok]
        far = apart(maps, i, j)
        sizes = n[i] + n[j]
        ok = (sizes - far) * (100 + percent) >= 2 * sizes * percent
        found.append(np.stack((i[ok], j[ok], far[ok]), axis=1))
        s = e
    return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 3), np.int64), columns=["i", "j", "apart"])


def _meet(percent: int, only_best: bool, rows: int = 20_000):
    """Whole groups to pairs x, y: of each x in a group its likeliest partner, or all that can link with what the counts need."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        met = met_in(pdf, percent)
        key, n, need, rest = (pdf[c].to_numpy(np.int64) for c in ("key", "n", "need", "rest"))
        i, j = met["i"].to_numpy(np.int64), met["j"].to_numpy(np.int64)
        sizes, near = n[i] + n[j], met["apart"].to_numpy(float)
        near = near / np.maximum(sizes, 1)
        if only_best:
            order = np.lexsort((key[j], near, i))
            i, j, near, sizes = i[order], j[order], near[order], sizes[order]
            best = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
            i, j, near, sizes = i[best], j[best], near[best], sizes[best]
        return pd.DataFrame({"x": key[i], "y": key[j], "least": np.minimum(need[i], need[j]), "sizes": sizes, "behind": np.maximum(rest[i], rest[j]), "near": near})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < rows:
                continue
            all_ = pd.concat(held)
            tok, slot = all_["tok"].to_numpy(), all_["slot"].to_numpy()
            turns = np.flatnonzero((tok[1:] != tok[:-1]) | (slot[1:] != slot[:-1])) + 1
            if len(turns):  # the last group may go on
                yield pairs(all_.iloc[: turns[-1]])
                all_ = all_.iloc[turns[-1] :]
            held, size = [all_], len(all_)
        if size:
            yield pairs(pd.concat(held))

    return run


PAIRS = "x long, y long, least long, sizes long, behind long, near double"


def _alike(size: int, percent: int):
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        """Whether 100 * shared >= percent * union, by the whole sets of two texts."""
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        out = []
        for i in range(0, len(x), 100):
            raw = [unpack(t) for t in [*x.iloc[i : i + 100], *y.iloc[i : i + 100]]]
            s, end = shingle_sets(raw, size)
            parts = np.split(s, end[:-1])
            for a, b in zip(parts[: len(raw) // 2], parts[len(raw) // 2 :], strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return run


def join(docs: DataFrame, stage: Stage, size: int = 3, percent: int = 90, most: int = 12, rounds: int = 1, block: int = 4096) -> DataFrame:
    """d, rk, n_shingles, component, component_rk: the smallest (d, rk) reachable over pairs with 100 * shared >= percent * union.

    rounds: how often nodes are verified against hubs and likeliest partners before all pairs that are left.
    """
    spark = docs.sparkSession
    own = keyed(docs)
    both = stage.write(own.mapInPandas(_measure(size), "d long, rk long, key long, n long, slice int, counts binary"))
    measured = both.where("slice < 0").drop("slice", "counts")
    # tasks' counts are added in lots first, so that no group grows with the number of tasks
    lots = both.where("slice >= 0").select("slice", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("lot"), "counts")
    tally = lots.groupBy("slice", "lot").applyInPandas(_add, "slice int, lot long, counts binary").groupBy("slice").applyInPandas(_add, "slice int, lot long, counts binary")
    tally = tally.orderBy("slice").collect()
    counts = np.concatenate([np.frombuffer(r.counts, "<i8") for r in tally]) if tally else np.zeros(1 << BITS, np.int64)
    sent = spark.sparkContext.broadcast((counts, max(1, measured.count())))  # 2 MB
    nodes = measured.where("n > 0").groupBy("key").agg(F.min(F.struct("d", "rk")).alias("rep"))
    posted = own.mapInPandas(_postings(size, percent, most, sent), "tok long, key long, n int, need byte, at int, rest int")
    # dealt once by token: equal sets post alike, and their lists are counted where they lie
    posted = posted.repartition("tok").distinct().withColumn("c", F.count("*").over(Window.partitionBy("tok"))).where("c > 1")
    common = stage.write(posted)
    stage.free()
    enough = common.groupBy("key").agg(F.count("*").alias("can"), F.min("need").alias("least")).where(F.col("can") >= F.least("least", F.lit(FLOOR))).select("key", F.col("can").cast("int").alias("can"))
    p = stage.write(common.join(enough, "key"))
    stage.drop(common)
    wanted = p.select("key").distinct().join(nodes, "key").select("key", "rep.*")
    texts = own.join(wanted.hint("shuffle_hash"), ["d", "rk"]).select("key", "text").mapInPandas(lambda it: _packed(it, size), "key long, packed binary, bits binary")
    texts = stage.write(texts)
    stage.free()

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = texts.select(F.col("key").alias("x"), F.col("packed").alias("ix")), texts.select(F.col("key").alias("y"), F.col("packed").alias("iy"))
        full = pairs.join(x, "x").join(y, "y").where(F.pandas_udf(_alike(size, percent), "boolean")("ix", "iy"))
        return stage.write(full.select("x", "y").distinct())

    links, labels = None, None
    about = ["n", "need", "at", "rest", "can"]
    theirs = [F.col(c).alias(f"y{c}") for c in about]

    def placed() -> DataFrame:
        if labels is None:
            return p.withColumn("comp", F.col("key"))
        return p.join(labels.toDF("key", "to"), "key", "left").select("tok", "key", *about, "c", F.coalesce("to", "key").alias("comp"))

    def add(new: DataFrame) -> None:
        nonlocal links, labels
        old = labels
        links = new if links is None else links.unionByName(new)
        labels = components(stage, links, "x", "y")
        if old is not None:
            stage.drop(old)

    def reach(overlap, sizes=F.col("n") + F.col("yn")) -> Column:
        """Whether sets of these sizes, added up, can link if they share so many."""
        return overlap * (100 + percent) >= sizes * percent

    # shared tokens beyond the prefixes are behind one of them; those in them are at most what either shares with any
    behind = F.greatest("rest", "yrest")
    near = reach(F.least("n", "yn")) & reach(F.least("can", "ycan") + behind)
    near &= reach(F.least("at", "yat") + F.least(F.col("n") - F.col("at"), F.col("yn") - F.col("yat")))
    counted = (F.count("*").alias("c"), F.min(F.least("need", "yneed")).alias("least"), F.first(F.col("n") + F.col("yn")).alias("sizes"), F.max(behind).alias("behind"))
    enough_shared = (F.col("c") >= F.col("least")) & reach(F.col("c") + F.col("behind"), F.col("sizes"))

    def hubs(turn: int) -> None:
        """Every node against the hub of one of its lists."""
        here = placed()
        lonely = F.col("n") - F.col("rest") - F.col("can")  # prefix tokens shared with no other
        one = here.groupBy("tok").agg(F.min(F.struct(lonely.alias("lonely"), F.xxhash64("key", F.lit(turn)).alias("h"), "key", *about, "comp")).alias("y")).select("tok", "y.*")
        one = one.select("tok", F.col("key").alias("y"), *theirs, F.col("comp").alias("ycomp"))
        met = here.join(one, "tok").where("comp <> ycomp").where(near).groupBy(F.col("key").alias("x"), "y").agg(*counted)
        best = met.where(enough_shared).groupBy("x").agg(F.max(F.struct("c", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
        add(verified(best))
        stage.free()

    bits = texts.select("key", "bits")

    def met(only_best: bool) -> DataFrame:
        """The pairs of the lists of several components, in groups (tok, slot): x marks nodes outside the largest, y all; x meets y."""
        here = placed().join(bits, "key")
        list_ = Window.partitionBy("tok")
        few = here.where(F.col("c") <= block).repartition("tok")
        few = few.withColumn("k", F.count("*").over(Window.partitionBy("tok", "comp")))
        few = few.withColumns({"m": F.max(F.struct("k", "comp")).over(list_), "lo": F.min("comp").over(list_), "hi": F.max("comp").over(list_)}).where("lo < hi")
        few = few.withColumns({"major": F.col("m.comp"), "slot": F.lit(0), "y": F.lit(True)}).withColumn("x", F.col("comp") != F.col("major"))
        # longer lists are never gathered: their components are summed, and their nodes meet in pairs of blocks
        many = here.where(F.col("c") > block)
        per = many.groupBy("tok", "comp").agg(F.count("*").alias("k")).groupBy("tok").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("m"))
        many = many.join(per.where("comps > 1").select("tok", F.col("m.comp").alias("major")), "tok").withColumn("x", F.col("comp") != F.col("major"))
        many = many.withColumn("slots", F.ceil(F.col("c") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("slots")).cast("int"))
        every = F.sequence(F.lit(0), F.col("slots") - 1)
        as_y, as_x = F.transform(every, lambda k: F.col("own") * F.col("slots") + k), F.transform(every, lambda k: k * F.col("slots") + F.col("own"))
        many = many.withColumn("slot", F.explode(F.when(F.col("x"), F.array_union(as_x, as_y)).otherwise(as_y)))
        many = many.withColumns({"x": F.col("x") & (F.pmod("slot", "slots") == F.col("own")), "y": F.floor(F.col("slot") / F.col("slots")) == F.col("own")})
        row = ["tok", "slot", "key", "n", "need", "at", "rest", "can", "comp", "major", "bits", "x", "y"]
        parts = few.select(*row).sortWithinPartitions("tok"), many.select(*row).repartition("tok", "slot").sortWithinPartitions("tok", "slot")
        return parts[0].mapInPandas(_meet(percent, only_best), PAIRS).unionByName(parts[1].mapInPandas(_meet(percent, only_best), PAIRS))

    for turn in range(rounds):
        hubs(turn)
        add(verified(met(only_best=True).groupBy("x").agg(F.min(F.struct("near", "y")).alias("m")).select("x", F.col("m.y").alias("y"))))
        stage.free()
    left = met(only_best=False)
    # which of a pair is x differs from list to list; what they share is counted over both directions
    left = left.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("c"), F.min("least").alias("least"), F.first("sizes").alias("sizes"), F.max("behind").alias("behind"))
    add(verified(left.where(enough_shared).select("x", "y")))
    stage.drop(texts, p)
    member = nodes.join(labels.toDF("key", "to"), "key", "left").select("key", "rep", F.coalesce("to", "key").alias("comp"))
    smallest = member.groupBy("comp").agg(F.min("rep").alias("least"))
    named = member.join(smallest, "comp").select("key", F.col("least.d").alias("component"), F.col("least.rk").alias("component_rk"))
    single = measured.where("n = 0").select("d", "rk", F.col("n").alias("n_shingles"), F.col("d").alias("component"), F.col("rk").alias("component_rk"))
    return measured.where("n > 0").join(named, "key").select("d", "rk", F.col("n").alias("n_shingles"), "component", "component_rk").unionByName(single)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = join(docs, Stage(spark, "op9"))
    return out.select(F.nullif("d", F.lit(LAST)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(LAST)).alias("component_id"))
