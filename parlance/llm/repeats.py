"""Repeated windows of any size over sampled suffixes: shared by the suffix-tree and suffix-array operators.

A window is `window` consecutive symbols (words or bytes). Each window start i is dealt to one anchor: the
position of the smallest fingerprint among the k-grams that begin in [i, i + w). As w + k - 1 <= window,
the anchor follows from the window's own symbols, so equal windows have equal anchors at equal offsets,
and only the suffixes that begin at anchors (2 in w + 1 positions) need be compared. An anchor's context
is all that its windows cover. Nothing is lost by the sampling: every window belongs to an anchor.

Suffixes with the same k-gram form a group. In a group, contexts that are equal are one entry with a
count; entries that differ are compared by sorting what follows the anchor and, reversed, what precedes it:
sorted order and common prefix lengths are the subtree of that prefix, and a window that starts s before
the anchor is repeated where a node at depth window - s on the right meets one at depth s on the left.

Prefixes have variable length. The sizes of all groups are measured, and only those whose tree would take more than
`most` bytes get a longer prefix: the windows of an entry, by how far before the anchor they start, fall into families
of `width`; all windows of family f hold the window - width + 1 symbols from f * width before the anchor, which
are the longer prefix of the suffix that begins there. The entry is trimmed to what its family's windows cover, and groups are
measured again. Widths shrink by four at a time. At width 1 the prefix is a window: it is the deep node itself, and is
counted by a distributed aggregate. So no group that goes to a task takes more than the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, Stage, Words, blocks, byte_symbols, encoded, mix

LAST = (1 << 63) - 1  # stands for a null doc_id, after all others


@dataclass(frozen=True)
class Spec:
    window: int
    k: int
    w: int  # a power of two
    words: bool

    def __post_init__(self):
        if self.w + self.k - 1 > self.window or self.w & (self.w - 1):
            raise ValueError("w must be a power of two, and w + k - 1 at most the window")


def anchors(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, spec: Spec) -> dict[str, np.ndarray]:
    """All anchors of documents [begin, end) of one symbol array, with the run of window starts of each."""
    n, k, size = len(symbols), spec.k, spec.window
    has = np.flatnonzero(end - begin >= size)
    none = {c: np.zeros(0, np.int64) for c in ("doc", "p", "lo", "hi", "kh", "ch")}
    if not len(has):
        return none
    roll = Rolling(symbols)
    at = np.arange(n - k + 1)
    grams = roll.of(at, at + k)
    bits = U64(int(n).bit_length())
    key = ((grams >> bits) << bits) | at.astype(U64)
    step = 1
    while step < spec.w:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    lengths = end[has] - begin[has] - size + 1
    offsets = np.cumsum(lengths) - lengths
    starts = np.arange(lengths.sum()) + np.repeat(begin[has] - offsets, lengths)
    pos = (key[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    turn = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (starts[1:] != starts[:-1] + 1))))
    lo, hi, p = starts[turn], starts[np.append(turn[1:], len(starts)) - 1], pos[turn]
    ch = mix(roll.of(lo, hi + size) + (p - lo + 1).astype(U64) * U64(0xD1342543DE82EF95))
    return {"doc": np.searchsorted(begin, lo, "right") - 1, "p": p, "lo": lo, "hi": hi, "kh": grams[p].view(np.int64), "ch": ch.view(np.int64)}


def symbols_of(texts: list[bytes], spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if spec.words:
        t = Words(texts)
        return t.hash, t.first, t.last
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(sizes)
    return byte_symbols(b"".join(texts)), end - sizes, end


def anchor_rows(docs: DataFrame, spec: Spec) -> DataFrame:
    """docs (d, rk, text) to d, rk, kh, ch, p, lo, hi; positions count from the document's start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text", 1_000_000):
            symbols, begin, end = symbols_of(encoded(pdf["text"]), spec)
            a = anchors(symbols, begin, end, spec)
            if len(doc := a["doc"]):
                own = pdf.iloc[doc]
                yield pd.DataFrame({"d": own["d"].to_numpy(), "rk": own["rk"].to_numpy(), "kh": a["kh"], "ch": a["ch"], **{c: (a[c] - begin[doc]).astype(np.int32) for c in ("p", "lo", "hi")}})

    return docs.mapInPandas(run, "d long, rk long, kh long, ch long, p int, lo int, hi int")


def keyed(docs: DataFrame) -> DataFrame:
    """d, rk, text: rk tells apart rows with one doc_id and different texts; equal rows share it and get equal results."""
    return docs.select(F.coalesce(docs["doc_id"], F.lit(LAST)).alias("d"), F.xxhash64(docs["doc_id"], docs["text"]).alias("rk"), docs["text"].alias("text"))


def meeting(stage: Stage, a: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The anchors of prefixes (kh) that occur more than once; a, which is many times that, goes."""
    prefixes = stage.write(prefixes)  # a plain table, so that a prefix that a third of the anchors have can be split
    near = stage.write(a.join(prefixes, "kh", "left_semi"))
    stage.drop(a, prefixes)
    stage.free()
    return near


def entries(a: DataFrame) -> DataFrame:
    """One row per different context: how many occurrences, the smallest document, and where one occurrence is."""
    return a.groupBy("kh", "ch").agg(F.count("*").alias("n"), F.min("d").alias("d1"), F.min(F.struct("d", "rk", "p", "lo", "hi")).alias("rep"))


def cut(docs: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """The contexts of wanted entries, from the documents that hold them: kh, ch, n, d1, smin, smax, context."""
    per_doc = wanted.groupBy(F.col("rep.d").alias("d"), F.col("rep.rk").alias("rk")).agg(F.collect_list(F.struct("kh", "ch", "n", "d1", "rep.p", "rep.lo", "rep.hi")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text", 2_000_000):
            rows = []
            for raw, at in zip(encoded(pdf["text"]), pdf["at"], strict=True):
                parts = raw.split() if spec.words else raw
                for e in at:
                    x = parts[e["lo"] : e["hi"] + spec.window]
                    rows.append((e["kh"], e["ch"], e["n"], e["d1"], e["p"] - e["hi"], e["p"] - e["lo"], b" ".join(x) if spec.words else x))
            yield pd.DataFrame(rows, columns=["kh", "ch", "n", "d1", "smin", "smax", "context"])

    joined = docs.join(per_doc.hint("shuffle_hash"), ["d", "rk"]).select("text", "at")
    return joined.mapInPandas(run, "kh long, ch long, n long, d1 long, smin int, smax int, context binary")


def _order(group: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (group, symbols), and the common prefix length of each with the one before; -1 between groups."""
    big = matrix.astype(">u8").view(np.uint8).reshape(len(matrix), -1) if matrix.dtype == U64 else matrix
    key = np.concatenate((group.astype(">u4").view(np.uint8).reshape(-1, 4), big), axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    m, g = matrix[order], group[order]
    differ = m[1:] != m[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return order, np.concatenate(([-1], np.where(g[1:] != g[:-1], -1, lcp)))


def nodes(lcp: np.ndarray, depth: int) -> np.ndarray:
    """The tree's nodes at a depth, as a number for each suffix in sorted order: an interval of suffixes whose common prefixes
    reach the depth is what hangs below one internal node (or a leaf, alone)."""
    return np.cumsum(lcp < depth)


def subtree(pdf: pd.DataFrame, spec: Spec) -> pd.DataFrame:
    """Whole prefix groups to the runs of offsets s whose windows occur more than once, with the smallest document of each."""
    pdf = pdf.drop_duplicates(["prefix", "kh", "ch", "smin"])
    rows, size = len(pdf), spec.window
    group = np.unique(pdf["prefix"].to_numpy(), return_inverse=True)[1]
    smin, smax = pdf["smin"].to_numpy(np.int64), pdf["smax"].to_numpy(np.int64)
    n, d1 = pdf["n"].to_numpy(np.int64), pdf["d1"].to_numpy(np.int64)
    texts = list(pdf["context"])
    if spec.words:
        t = Words(texts)
        symbols, begin = t.hash, t.first
    else:
        symbols = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, rows)
        begin = np.cumsum(sizes) - sizes
    here = begin + smax

    def take(width: np.ndarray, most: int, sign: int) -> np.ndarray:
        j = np.arange(most)
        i = np.clip(here[:, None] + (j if sign > 0 else -1 - j), 0, len(symbols) - 1)
        return np.where(j < width[:, None], symbols[i], symbols.dtype.type(0))

    right, rlcp = _order(group, take(size - smin, size, 1))
    left, llcp = _order(group, take(smax, max(1, int(smax.max())), -1))
    low, high = int(smin.min()), int(smax.max())
    value = np.zeros((rows, high - low + 1), np.int64)
    again = np.zeros(value.shape, bool)
    rc, lc = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for s in range(low, high + 1):
        here_s = np.flatnonzero((smin <= s) & (s <= smax))
        rc[right], lc[left] = nodes(rlcp, size - s), nodes(llcp, s)
        _, node = np.unique(rc[here_s] * (rows + 1) + lc[here_s], return_inverse=True)
        total = np.bincount(node, n[here_s])
        first = np.full(len(total), LAST, np.int64)
        np.minimum.at(first, node, d1[here_s])
        again[here_s, s - low] = total[node] >= 2
        value[here_s, s - low] = np.where(total[node] >= 2, first[node], 0)
    edge = np.ones_like(again)
    edge[:, 1:] = (value[:, 1:] != value[:, :-1]) | (again[:, 1:] != again[:, :-1])
    at = np.flatnonzero(edge.ravel())
    stop = np.append(at[1:], value.size) - 1
    keep = again.ravel()[at]
    at, stop = at[keep], stop[keep]
    row = at // value.shape[1]
    out = pdf[["kh", "ch"]].iloc[row].reset_index(drop=True)
    return out.assign(s_lo=(at % value.shape[1] + low).astype(np.int32), s_hi=(stop % value.shape[1] + low).astype(np.int32), first=value.ravel()[at])


RUNS = "kh long, ch long, s_lo int, s_hi int, first long"


def grow(contexts: DataFrame, spec: Spec, rows: int = 6000) -> DataFrame:
    """The subtrees of all groups, about `rows` contexts at a time; a group is never divided."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            while len(rest) > rows:
                prefix = rest["prefix"].to_numpy()
                end = np.searchsorted(prefix, prefix[rows - 1], "left") or np.searchsorted(prefix, prefix[0], "right")
                if end == len(rest):
                    break
                yield subtree(rest.iloc[:end], spec)
                rest = rest.iloc[end:]
        if rest is not None and len(rest):
            yield subtree(rest, spec)

    return contexts.repartition("prefix").sortWithinPartitions("prefix").mapInPandas(run, RUNS)


class Cut:
    """The symbols of contexts, where each begins, and the bytes of any run of them."""

    def __init__(self, texts: list[bytes], spec: Spec):
        if spec.words:
            self.words = Words(texts)
            self.symbols, self.begin = self.words.hash, self.words.first
        else:
            self.words, self.raw = None, b"".join(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            self.symbols, self.begin = byte_symbols(self.raw), np.cumsum(sizes) - sizes

    def bytes(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        if not self.words:
            return [self.raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        w = self.words
        return [w.raw[a:b] for a, b in zip(w.start[start].tolist(), w.end[end - 1].tolist(), strict=True)]


NODE = "prefix long, kh long, ch long, n long, d1 long, smin int, smax int, context binary"


def lengthen(rows: DataFrame, spec: Spec, width: int) -> DataFrame:
    """rows under prefixes of window - width + 1 symbols: one for each family of windows that an entry has, trimmed to what they cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "context", 200_000):
            t = Cut(list(pdf["context"]), spec)
            smin, smax = pdf["smin"].to_numpy(np.int64), pdf["smax"].to_numpy(np.int64)
            first, count = smin // width, smax // width - smin // width + 1
            row = np.repeat(np.arange(len(pdf)), count)
            family = first[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            low, high = np.maximum(smin[row], family * width), np.minimum(smax[row], family * width + width - 1)
            anchor = (t.begin + smax)[row]
            begin = anchor - family * width
            h = Rolling(t.symbols).of(begin, begin + spec.window - width + 1)
            own = pdf.iloc[row]
            same = {c: own[c].to_numpy() for c in ("kh", "ch", "n", "d1")}
            prefix = mix(h + family.astype(U64) * U64(0xC2B2AE3D27D4EB4F)).view(np.int64)
            yield pd.DataFrame({"prefix": prefix, **same, "smin": low.astype(np.int32), "smax": high.astype(np.int32), "context": t.bytes(anchor - high, anchor - low + spec.window)})

    return rows.mapInPandas(run, NODE)


def deep(rows: DataFrame, spec: Spec) -> DataFrame:
    """As grow, where the prefix of each window is the window itself: the nodes are counted by an aggregate, of any size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "context", 200_000):
            t = Cut(list(pdf["context"]), spec)
            smin, smax = pdf["smin"].to_numpy(np.int64), pdf["smax"].to_numpy(np.int64)
            count = smax - smin + 1
            row = np.repeat(np.arange(len(pdf)), count)
            back = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = t.begin[row] + back
            h = Rolling(t.symbols).of(start, start + spec.window)
            h2 = Rolling(mix(t.symbols)).of(start, start + spec.window)
            own = pdf.iloc[row]
            yield pd.DataFrame({**{c: own[c].to_numpy() for c in ("kh", "ch", "n", "d1")}, "s": (smax[row] - back).astype(np.int32), "h": h.view(np.int64), "h2": h2.view(np.int64)})

    leaf = rows.dropDuplicates(["kh", "ch", "smin"]).mapInPandas(run, "kh long, ch long, n long, d1 long, s int, h long, h2 long")
    key = ["kh", "s", "h", "h2"]
    seen = leaf.groupBy(*key).agg(F.sum("n").alias("total"), F.min("d1").alias("first")).where("total >= 2")
    return leaf.join(seen, key).select("kh", "ch", F.col("s").alias("s_lo"), F.col("s").alias("s_hi"), "first")


MOST = 64 << 20  # bytes that one group's tree may take


def divided(stage: Stage, contexts: DataFrame, spec: Spec, most: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Contexts under prefixes of variable length: groups that fit, by length of prefix, and the windows of those that never do.

    A tree takes the bytes of its contexts and, for each, two rows of symbols and one of values, 16 bytes a symbol of the window."""
    rows, width, fit = stage.write(contexts.withColumn("prefix", F.col("kh"))), spec.w, []
    size = F.sum(F.length("context") + 16 * spec.window)
    while True:
        large = stage.write(rows.groupBy("prefix").agg(size.alias("size")).where(F.col("size") > most).select("prefix"))
        if large.isEmpty():
            return [*fit, rows], None
        fit.append(rows.join(large, "prefix", "left_anti"))
        rest = rows.join(large, "prefix", "left_semi")
        width //= 4
        if width <= 1:
            return fit, rest
        rows = stage.write(lengthen(rest, spec, width))


def runs(stage: Stage, docs: DataFrame, found: DataFrame, spec: Spec, most: int = MOST) -> DataFrame:
    """found: entries (of groups with two occurrences or more) with m, the contexts in the group. The repeated offsets of each."""
    same = found.where("m = 1").select("kh", "ch", F.expr("rep.p - rep.hi").alias("s_lo"), F.expr("rep.p - rep.lo").alias("s_hi"), F.col("d1").alias("first"))
    before = set(stage.paths)
    fit, leaves = divided(stage, cut(docs, found.where("m > 1"), spec), spec, most)
    parts = [grow(rows, spec) for rows in fit] + ([] if leaves is None else [deep(leaves, spec)])
    every = same
    for p in parts:
        every = every.unionByName(p)
    out = stage.write(every)
    stage.drop(found, *[frame for k, (frame, _) in list(stage.paths.items()) if k not in before and frame is not out])
    return out


def groups(found: DataFrame) -> DataFrame:
    """Entries of prefix groups with two occurrences or more, with m."""
    m = found.groupBy("kh").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("all >= 2").select("kh", "m")
    return found.join(m, "kh")


def spans(a: DataFrame, repeated: DataFrame, spec: Spec, earlier: bool) -> DataFrame:
    """Per document, the symbol ranges that repeated windows cover. earlier: only windows that a smaller document has."""
    x = a.join(repeated, ["kh", "ch"])
    if earlier:
        x = x.where("first < d")
    x = x.select("d", "rk", F.struct((F.col("p") - F.col("s_hi")).alias("a"), (F.col("p") - F.col("s_lo") + spec.window).alias("b")).alias("span"))
    return x.groupBy("d", "rk").agg(F.collect_list("span").alias("spans"))


def covered(n: int, found) -> np.ndarray:
    """True where a range covers the symbol."""
    depth = np.zeros(n + 1, np.int32)
    if found is not None and len(found):
        np.add.at(depth, [s["a"] for s in found], 1)
        np.add.at(depth, [s["b"] for s in found], -1)
    return np.cumsum(depth[:-1]) > 0
