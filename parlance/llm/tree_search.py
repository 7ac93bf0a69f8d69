"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves the space again and again: the direction of a node is the difference of two of its sample vectors,
drawn by a seed, the threshold the median of the projections. A query walks all trees at once through one priority
queue: a node's priority is the smallest margin by which the query stands on the node's side of the thresholds above
it, so where a query is close to a threshold, the other side comes next, in whichever tree. Leaves are taken until they
hold enough vectors; these are ranked by their exact inner products. Priorities never fall on the way down, so the queue
hands out leaves by their own priorities, and sorting these gives its order for many queries at once.

Largest inner products are nearest neighbours after one more component (Bachrach et al. 2014): candidates get what
their length lacks of the greatest length, queries zero, and queries are scaled to that length. Scores are of the original vectors,
each product sum in double precision and in the order of the components, so a pair has one score wherever it meets.

Scale: thresholds come from at most `max_sample` different vectors, drawn by a seeded hash; every vector is routed. The forest
(trees * 2**depth directions, bounded by the sample), the sample and the leaves' counts are broadcast. Equal vectors are one node
with its smallest ids, equal queries one query. Neighbouring leaves of a tree are a group, which is split into parts by a hash
where it holds more than 32 * `block` vectors. A part's vectors come to one task once, ahead of the queries that take some of its
leaves, each of which comes once with a list of them: what moves grows with groups, not with leaves, and nothing is repeated for each pair
of rows that meet. The sample vectors in the leaves that a query takes give a bound that its best reach: tasks pass on no others.

How much of the table is searched is a share of it (`share`, counted over all trees, and at least `least` vectors), as the
given vectors fill their 64 dimensions evenly and no small part of them holds the neighbours. Work then grows with
queries times vectors; where vectors have structure, a smaller share does. Recall is measured in the tests.

Cases: vectors that are null, empty, zero, or hold null or non-finite components neither ask nor answer. Vectors of different
length don't meet. Rows that repeat id and vector are one candidate and one query; one id with two vectors is two of
both. A null vec_id asks nothing and comes last among equal scores. Products that overflow are infinite; an undefined one
(infinity less infinity) counts as the smallest. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Stage, mix, revive
from .repeats import LAST

def stacked(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def joined(raw: Iterable[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled first, as squares of the largest numbers would overflow."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((x / most) ** 2).sum(axis=1))


class Trees:
    """Directions and thresholds by vector length; nodes of a tree are numbered 2i + 1 and 2i + 2 below i."""

    def __init__(self, trees: int, depth: int, seed: int, longest: float):
        self.trees, self.depth, self.seed, self.longest = trees, depth, seed, longest
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.known: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}  # the sample, its leaves and its greatest length
        self.sizes: dict[tuple[int, int], int] = {}
        self.listed: dict[int, tuple[np.ndarray, ...]] = {}  # leaves that hold vectors: places, numbers and sizes, once asked for
        self.shift = 0  # levels between a leaf and its group
        self.parts: dict[tuple[int, int], int] = {}  # of groups

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Candidates, all of one length."""
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Queries, of the same length."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def fit(self, x: np.ndarray) -> None:
        dim, y = x.shape[1], self.lifted(x)
        nodes = (1 << self.depth) - 1
        direction, threshold = np.zeros((self.trees, nodes, dim + 1)), np.zeros((self.trees, nodes))
        for t in range(self.trees):
            rng = np.random.default_rng([self.seed, dim, t])
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                order = np.argsort(at, kind="stable")
                first = (1 << level) - 1
                edge = np.searchsorted(at[order], np.arange(first, 2 * first + 2))
                for node, a, b in zip(range(first, 2 * first + 1), edge[:-1], edge[1:], strict=True):
                    own = y[order[a:b]]
                    d = np.subtract(*own[rng.choice(b - a, 2, replace=False)]) if b - a > 1 else rng.standard_normal(dim + 1)
                    d = d / (np.sqrt((d * d).sum()) or 1)
                    direction[t, node], threshold[t, node] = d, np.median(own @ d) if b > a else 0
                at = 2 * at + 1 + (np.einsum("ij,ij->i", y, direction[t, at]) > threshold[t, at])
        self.cuts[dim] = (direction, threshold)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each candidate in each tree; leaves are numbered over the trees."""
        if x.shape[1] not in self.cuts:
            return np.zeros((len(x), 1), np.int64)
        (direction, threshold), y = self.cuts[x.shape[1]], self.lifted(x)
        out = []
        for t in range(self.trees):
            at = np.zeros(len(y), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", y, direction[t, at]) > threshold[t, at])
            out.append(at + (t << self.depth + 1))
        return np.stack(out, axis=1)

    def search(self, x: np.ndarray, enough: int) -> list[list[int]]:
        """For each query the leaves to look into, in the order of the queue."""
        dim = x.shape[1]
        if dim not in self.cuts:
            return [[0]] * len(x)
        (direction, threshold), inner = self.cuts[dim], (1 << self.depth) - 1
        margins = np.einsum("qd,tnd->qtn", self.asked(x), direction, optimize=True) - threshold
        far = np.full((len(x), self.trees, 1), -np.inf)  # the smallest comes first, so priorities are negative
        for level in range(self.depth):
            m = margins[:, :, (1 << level) - 1 : (2 << level) - 1]
            far = np.stack([np.maximum(far, m), np.maximum(far, -m)], axis=3).reshape(len(x), self.trees, -1)
        if dim not in self.listed:
            leaf = (inner + np.arange(inner + 1) + (np.arange(self.trees)[:, None] << self.depth + 1)).ravel()
            size = np.array([self.sizes.get((dim, i), 0) for i in leaf.tolist()])
            full = np.flatnonzero(size)
            self.listed[dim] = full, leaf[full], size[full]
        full, leaf, size = self.listed[dim]
        far = far.reshape(len(x), -1)[:, full]
        # leaves are about as large as each other, so a quarter more than the mean leaf asks for are sorted first, and all where these hold too few
        likely = int(1.25 * len(size) * min(1.0, enough / max(1, size.sum())))
        taken = []
        for row in far:
            near = np.flatnonzero(row <= np.partition(row, likely)[likely]) if likely < len(row) else np.arange(len(row))
            if size[near].sum() < enough:
                near = np.arange(len(row))
            near = near[np.argsort(row[near], kind="stable")]
            before = np.cumsum(size[near]) - size[near]
            taken.append(leaf[near[: np.searchsorted(before, enough)]].tolist())
        return taken

    def floor(self, x: np.ndarray, taken: list[list[int]], most: int) -> np.ndarray:
        """For each query a score that `most` different vectors in the leaves taken reach, as those of the sample tell."""
        known, leaves, longest = self.known.get(x.shape[1], (np.zeros((0, x.shape[1])), None, 0.0))
        if len(known) < most:
            return np.full(len(x), -np.inf)
        seen = np.zeros((len(x), self.trees << self.depth + 1), bool)
        seen[np.repeat(np.arange(len(x)), list(map(len, taken))), [i for t in taken for i in t]] = True
        reached = np.zeros((len(x), len(known)), bool)
        for own in leaves.T:
            reached |= np.take(seen, own, axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.where(reached, defined(x @ known.T.astype(np.float64)), -np.inf)
            return defined(np.partition(s, len(known) - most, axis=1)[:, -most] - 1e-12 * lengths(x) * longest)

    def grouped(self, leaf: np.ndarray) -> np.ndarray:
        """The group of each leaf: a node above it, or its own."""
        return leaf + 1 >> self.shift


class Best:
    """The nearest nodes found so far of the queries that a task sees. Entries are kept in plain arrays, and sorted only when there are many:
    nearest first, ties to the smaller id (the smallest of each node's); a candidate that came through several trees counts once."""

    def __init__(self, most: int, side: int = 1024):
        self.most, self.side, self.kept, self.size, self.limit = most, side, [], 0, 400_000
        self.bar: dict[int, float] = {}  # no entry below it can be among the best of its query

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, node: np.ndarray) -> None:
        self.kept.append((query, score, ids, node))
        self.size += len(query)
        if self.size > self.limit:
            self.shrink()
            self.limit = max(400_000, 2 * self.size)

    def shrink(self) -> tuple[np.ndarray, ...]:
        query, score, ids, node = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        order = np.lexsort((node, ids, -score, query))
        query, score, ids, node = query[order], score[order], ids[order], node[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (node[1:] != node[:-1])
        query, score, ids, node = query[new], score[new], ids[new], node[new]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = place == self.most - 1
        self.bar |= dict(zip(query[full].tolist(), score[full].tolist(), strict=True))
        keep = place < self.most
        out = query[keep], score[keep], ids[keep], node[keep]
        self.kept, self.size = [out], int(keep.sum())
        return out

    def tiles(self, runs: Iterable[tuple[int, int]], at: np.ndarray, taken: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Queries and the vectors they meet, of a leaf or, where it is large, of a part of it that fits into the processor's cache."""
        for i, j in runs:
            first, last = np.searchsorted(leaf, (taken[i], taken[i] + 1)).tolist()
            for row in range(i, j, self.side):
                for start in range(first, last, self.side):
                    yield at[row : min(j, row + self.side)], start, min(last, start + self.side)

    def meet(self, q: np.ndarray, queries: np.ndarray, low: np.ndarray, at: np.ndarray, taken: np.ndarray, x: np.ndarray, most: float, leaf: np.ndarray, nodes: np.ndarray, ids: np.ndarray) -> None:
        """Compares queries with the vectors in the leaves they take: query at[i] takes leaf taken[i]; x is in the order of leaf, and
        no longer than `most`. No entry below `low` can be among the best of its query."""
        low = np.maximum(low, [self.bar.get(i, -np.inf) for i in queries.tolist()])
        long = lengths(q)
        # single precision tells what can't be among the best; where it could overflow, and where scores do, double
        fine = long.max() < 1e15 and long.min() > 1e-15 and 1e-15 < most < 1e15
        kind = np.float32 if fine else np.float64
        a, b, order = q.astype(kind), x.astype(kind), np.argsort(taken, kind="stable")
        at, taken = at[order], taken[order]
        with np.errstate(over="ignore", invalid="ignore"):
            slack = max(1e-12, (q.shape[1] + 8) * float(np.finfo(kind).eps)) * long * most
            bar = defined(low - slack).astype(kind)
            edge = np.flatnonzero(np.diff(taken, prepend=-1, append=-1))
            for own, start, end in self.tiles(zip(edge[:-1], edge[1:], strict=True), at, taken, leaf):
                s, least = a[own] @ b[start:end].T, bar[own]
                s = s if fine else defined(s)
                if end - start > self.most and np.isneginf(least).any():
                    none = np.flatnonzero(np.isneginf(least))
                    least[none] = defined(-np.partition(-s[none], self.most - 1, axis=1)[:, self.most - 1] - 2 * slack[own[none]])
                # rounding depends on the shapes of a product: what comes close to the last place is summed again, in order
                row, column = np.divmod(np.flatnonzero(s >= least[:, None]), end - start)
                for k in range(0, len(row), 65536):
                    r, c = own[row[k : k + 65536]], start + column[k : k + 65536]
                    score = defined(np.cumsum(q[r] * x[c], axis=1)[:, -1])
                    keep = score >= low[r]
                    self.add(queries[r[keep]], score[keep], ids[c[keep]], nodes[c[keep]])


def defined(s: np.ndarray) -> np.ndarray:
    return np.nan_to_num(s, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def nearest(vectors: DataFrame, asks: Column, stage: Stage, k: int = 20, trees: int = 8, leaf: int = 256, share: float = 1.1, least: int = 5000, max_sample: int = 20_000, block: int = 1024, seed: int = 11) -> DataFrame:
    """vectors (vec_id, embedding) to query, rank, id, score for the rows where `asks` holds; asks is an expression of vec_id."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind = "<f4" if single else "<f8"
    e = vectors["embedding"]
    valid = F.coalesce((F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    own = vectors.where(valid).select(F.coalesce("vec_id", F.lit(LAST)).alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), e.alias("e"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["e"].map(len)):
                x = np.stack(part["e"].to_list()).astype(kind) + np.zeros(1, kind)  # -0.0 and 0.0 are one value
                yield pd.DataFrame({"id": part["id"], "asks": part["asks"], "v": [v.tobytes() for v in x], "length": lengths(x.astype(np.float64))})

    rows = own.mapInPandas(pack, "id long, asks boolean, v binary, length double")
    one = rows.groupBy("v", "id").agg(F.max("length").alias("length"), F.max("asks").alias("asks"))  # rows that repeat both are one
    one = stage.write(one)
    # of equal vectors the smallest k + 1 ids can be found; the limit on the rank holds before the shuffle as well
    place = F.rank().over(Window.partitionBy("v").orderBy("id"))
    few = one.select("v", "id", "length", place.alias("place")).where(F.col("place") <= k + 1)
    nodes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("length").alias("length")).withColumn("node", F.monotonically_increasing_id())
    nodes = stage.write(nodes.withColumn("id", F.get("ids", F.lit(0))))
    total = nodes.agg(F.count("*").alias("n"), F.max("length").alias("longest")).first()
    sample = [r.v for r in nodes.orderBy(F.xxhash64(F.lit(seed), "v")).select("v").limit(max_sample).collect()]
    depth = max(0, min(int(np.ceil(np.log2(max(1, total.n / leaf)))), int(np.log2(max(1, len(sample) / 8)))))
    forest = Trees(trees, depth, seed, min(total.longest or 1.0, 1e300))
    for dim in sorted({len(v) for v in sample}):
        x = stacked([v for v in sample if len(v) == dim], kind)
        forest.fit(x)
        forest.known[x.shape[1]] = x.astype(kind), forest.route(x), float(lengths(x).max())
    sent = spark.sparkContext.broadcast(vars(forest))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = revive(Trees, sent.value)
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].str.len()):
                x = stacked(list(part["v"]), kind)
                yield part.assign(dim=np.int32(x.shape[1]), leaves=list(plan.route(x)))

    routed = stage.write(nodes.mapInPandas(route, "v binary, ids array<long>, length double, node long, id long, dim int, leaves array<long>"))
    sizes = routed.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").agg(F.count("*").alias("m"))
    forest.sizes = {(r.dim, r.leaf): r.m for r in sizes.collect()}  # a row for each leaf of the forest
    # groups hold 16 to 32 blocks, but no tree has fewer than 16 groups where it has so many leaves
    forest.shift = max(0, min(depth - 4, int(np.log2(max(1, 32 * block * (1 << depth) / max(1, total.n))))))
    grown = Counter()
    for (dim, own_leaf), m in forest.sizes.items():
        grown[dim, forest.grouped(own_leaf)] += m
    forest.parts = {g: -(-m // (32 * block)) for g, m in grown.items()}
    told = spark.sparkContext.broadcast(vars(forest))
    enough = max(least, int(share * total.n))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each part of a group that vectors of a batch are in."""
        plan = revive(Trees, told.value)
        for pdf in batches:
            for dim, rows in pdf.groupby("dim"):
                v, node, ids, leaves = rows["v"].to_numpy(), rows["node"].to_numpy(np.int64), rows["id"].to_numpy(np.int64), np.stack(rows["leaves"].to_list())
                out, hashed = [], mix(node.astype(U64))
                for leaf in leaves.T:
                    group = plan.grouped(leaf)
                    part = (hashed % np.array([plan.parts[dim, g] for g in group.tolist()], U64)).astype(np.int64)
                    order = np.lexsort((part, group))
                    edge = np.flatnonzero((np.diff(group[order], prepend=-1, append=-1) != 0) | (np.diff(part[order], prepend=-1, append=-1) != 0))
                    for i, j in zip(edge[:-1], edge[1:], strict=True):
                        o = order[i:j]
                        out.append((dim, group[o[0]], part[o[0]], False, b"".join(v[o]), node[o].tobytes(), leaf[o].astype(np.int32).tobytes(), ids[o].tobytes(), None, None))
                yield pd.DataFrame(out, columns=names)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each part of a group that queries look into."""
        plan = revive(Trees, told.value)
        for pdf in batches:
            for dim, rows in pdf.groupby("dim"):
                for start in range(0, len(rows), 128):
                    some = rows.iloc[start : start + 128]
                    v, query = some["v"].to_numpy(), some["node"].to_numpy(np.int64)
                    x = stacked(list(v), kind)
                    steps = [x[i : i + 32] for i in range(0, len(x), 32)]  # their priorities stay in the processor's cache
                    found = [plan.search(y, enough) for y in steps]
                    low = np.concatenate([plan.floor(y, t, k + 1) for y, t in zip(steps, found, strict=True)])
                    taken = [t for f in found for t in f]
                    at = np.repeat(np.arange(len(some)), list(map(len, taken)))
                    leaf = np.array([i for t in taken for i in t], np.int64)
                    group = plan.grouped(leaf)
                    order = np.argsort(group, kind="stable")
                    at, leaf, group, out = at[order], leaf[order], group[order], []
                    edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
                    for i, j in zip(edge[:-1], edge[1:], strict=True):
                        own, place = np.unique(at[i:j], return_inverse=True)
                        row = True, b"".join(v[own]), query[own].tobytes(), leaf[i:j].astype(np.int32).tobytes(), None, place.astype(np.uint16).tobytes(), low[own].tobytes()
                        out += [(dim, group[i], part, *row) for part in range(plan.parts[dim, group[i]])]
                    yield pd.DataFrame(out, columns=names)

    kinds = "dim int, group long, part long, asks boolean, v binary, node binary, leaf binary, id binary, at binary, low binary"
    names = [c.split()[0] for c in kinds.split(", ")]
    asking = one.where("asks").select("v").distinct()
    tasks = 1 + total.n // 4096
    visits = routed.join(asking, "v", "left_semi").select("v", "node", "dim").repartition(tasks, "node").mapInPandas(search, kinds)
    packs = routed.select("v", "node", "id", "dim", "leaves").mapInPandas(deal, kinds)
    key = ["dim", "group", "part"]
    met = packs.unionByName(visits).repartition(max(1, sum(forest.parts.values())), *key).sortWithinPartitions(*key, "asks")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, last = Best(k + 1), None
        for held, run in _runs(batches):
            if held is not last:
                leaf = joined([r.leaf for r in held], np.int32)
                order, last = np.argsort(leaf, kind="stable"), held
                x = joined([r.v for r in held], kind).reshape(len(leaf), -1)[order]
                most = lengths(x.astype(np.float64)).max()
                leaf, nodes, ids = leaf[order], joined([r.node for r in held], np.int64)[order], joined([r.id for r in held], np.int64)[order]
            queries = joined([r.node for r in run], np.int64)
            q = joined([r.v for r in run], kind).reshape(len(queries), -1).astype(np.float64)
            before = np.cumsum([0, *(len(r.node) // 8 for r in run[:-1])])
            at = np.concatenate([np.frombuffer(r.at, np.uint16) + n for r, n in zip(run, before, strict=True)])
            top.meet(q, queries, joined([r.low for r in run], np.float64), at, joined([r.leaf for r in run], np.int32), x, most, leaf, nodes, ids)
            if top.size > 400_000 and len(top.shrink()[0]) > 200_000:  # many queries: what is found so far goes on
                yield from _rows(top.kept[0])
                top = Best(k + 1)
        if top.size:
            yield from _rows(top.shrink())

    def _runs(batches: Iterator[pd.DataFrame], most: int = 2048) -> Iterator[tuple[list, list]]:
        """The vectors of a part, with the next of the queries that come after them, until all have come."""
        part, held, run, many = None, [], [], 0
        for pdf in batches:
            for r in pdf.itertuples():
                key = r.dim, r.group, r.part
                if key != part or many >= most:
                    if held and run:
                        yield held, run
                    run, many = [], 0
                if key != part:
                    part, held = key, []
                if r.asks:
                    run.append(r)
                    many += len(r.node) // 8
                else:
                    held.append(r)
        if held and run:
            yield held, run

    def _rows(found: tuple[np.ndarray, ...]) -> Iterator[pd.DataFrame]:
        """One row for each set of queries that are merged together."""
        to = (mix(found[0].astype(U64)) % U64(tasks)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edge = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
        cut = [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pd.DataFrame({"to": [to[o[0]] for o in cut]} | {name: [x[o].tobytes() for o in cut] for name, x in zip(("query", "score", "id", "node"), found, strict=True)})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best of each query; the queries of a task are so few that it holds all of them."""
        top = Best(k + 1)
        for pdf in batches:
            for r in pdf.itertuples():
                top.add(*(np.frombuffer(raw, of) for raw, of in ((r.query, np.int64), (r.score, np.float64), (r.id, np.int64), (r.node, np.int64))))
        if top.size:
            query, score, _, node = top.shrink()
            yield pd.DataFrame({"query": query, "score": score, "node": node})

    tops = met.mapInPandas(compare, "to long, query binary, score binary, id binary, node binary").repartition(tasks, "to")
    tops = tops.mapInPandas(merge, "query long, score double, node long").join(nodes.select("node", F.explode("ids").alias("id")), "node")
    first = tops.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "node"))), 1, k + 1).alias("top"))
    ids = one.where("asks").select("v", "id").join(routed.select("v", F.col("node").alias("query")), "v").select("query", F.col("id").alias("own"))
    others = F.filter("top", lambda c: ~((c["id"] == F.col("own")) & (c["node"] == F.col("query"))))
    out = ids.join(first, "query").select("own", F.posexplode(F.slice(others, 1, k)).alias("rank", "c"))
    return out.select(F.col("own").alias("query"), (F.col("rank") + 1).alias("rank"), F.nullif("c.id", F.lit(LAST)).alias("id"), (-F.col("c.far")).alias("score"))


def op11_tree_search(spark, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = nearest(own, F.expr("vec_id % 20 = 0"), Stage(spark, "op11"))
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
