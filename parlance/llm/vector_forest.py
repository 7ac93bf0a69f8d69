"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree halves the space again and again: one seeded random direction per level, and at each node the median
of a bounded sample as the threshold. Vectors within a band around the threshold go to both sides. Every vector
is routed through every tree; the vectors of a leaf are compared with each other, in double precision.

A pair that meets in several leaves counts in the smallest leaf that both share: each vector carries the
numbers of its leaves, so a leaf adds up its links without listing pairs, and passes on a spanning forest of
its links for the components. Equal vectors are one node with a count. Leaves of more than `block` vectors are
compared as pairs of blocks in tasks of their own, so no leaf need fit one task and none is cut short.

The sample (`max_sample` different vectors in the order of a seeded hash) only sets the first thresholds; all vectors
are indexed. Leaves that hold more than `split` vectors then are split on, each at the median of its own vectors, so
depth follows the table and not the sample. There the band is also as wide as links of the threshold reach, and a
leaf that lies within it (a group of near copies) is left whole and compared in blocks: no link is cut to make
leaves small. Pairs near several thresholds in all trees can be missed: recall is measured in the tests.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of
different length do not link. A null vec_id comes after all others. Repeated rows are vectors of their own. An
empty table gives no rows; other columns, labels among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, components, revive
from .repeats import LAST


def unit(rows: list) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in rows])
    # scaled first: squares of the largest numbers would overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Thresholds and bands by vector length, tree and node; a node's children are 2i + 1 and 2i + 2."""

    def __init__(self, trees: int, depth: int, spill: float, seed: int):
        self.trees, self.depth, self.spill, self.seed = trees, depth, spill, seed
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def direction(self, dim: int, tree: int, level: int) -> np.ndarray:
        v = np.random.default_rng([self.seed, dim, tree, level]).standard_normal(dim)
        return v / np.linalg.norm(v)

    def fit(self, x: np.ndarray) -> None:
        nodes = (1 << self.depth) - 1
        thr, band = np.zeros((self.trees, nodes)), np.zeros((self.trees, nodes))
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                p = x @ self.direction(x.shape[1], t, level)
                for node in range((1 << level) - 1, (1 << level + 1) - 1):
                    own = p[at == node]
                    if len(own):
                        low, mid, high = np.quantile(own, [0.5 - self.spill, 0.5, 0.5 + self.spill])
                        thr[t, node], band[t, node] = mid, (high - low) / 2
                at = 2 * at + 1 + (p > thr[t, at])
        self.cuts[x.shape[1]] = (thr, band)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row falls in, in all trees; leaves are numbered over the trees."""
        dim = x.shape[1]
        if dim not in self.cuts:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        thr, band = self.cuts[dim]
        rows_out, leaves_out = [], []
        for t in range(self.trees):
            rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                p = (x @ self.direction(dim, t, level))[rows]
                left, right = p <= thr[t, at] + band[t, at], p > thr[t, at] - band[t, at]
                rows, at = np.concatenate((rows[left], rows[right])), np.concatenate((2 * at[left] + 1, 2 * at[right] + 2))
            rows_out.append(rows)
            leaves_out.append(at + t * (2 << self.depth))
        return np.concatenate(rows_out), np.concatenate(leaves_out)


LEVELS = 16  # how often a leaf of the sample's trees can be split on


def _refined(routed: DataFrame, sizes: DataFrame, stage: Stage, forest: Forest, threshold: float, split: int) -> DataFrame:
    """routed with the leaves of more than split vectors replaced by leaves of trees that go on from there.

    A vector is projected once, on the directions of all further levels; what then moves is ids and projections.
    """
    sent = routed.sparkSession.sparkContext.broadcast(vars(Forest(forest.trees, forest.depth, forest.spill, forest.seed)))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, known = revive(Forest, sent.value), {}
        for pdf in batches:
            for (dim, tree), part in pdf.groupby(["dim", pdf["leaf"] // (2 << plan.depth)]):
                if (dim, tree) not in known:
                    known[dim, tree] = np.stack([plan.direction(int(dim), int(tree), plan.depth + k) for k in range(LEVELS)], axis=1)
                yield part[["node", "dim", "leaf"]].assign(p=list(unit(list(part["v"])) @ known[dim, tree]))

    at, p = ["dim", "leaf"], F.col("p")
    placed = routed.select("v", "node", "dim", F.explode("leaves").alias("leaf"))
    small = placed.drop("v").join(sizes.where(F.col("m") <= split).select(*at), at).select("node", "dim", "leaf")
    large = placed.join(sizes.where(F.col("m") > split).select(*at), at)
    rest = stage.write(large.select("v", "node", "dim", "leaf").mapInPandas(project, "node long, dim int, leaf long, p array<double>"))
    reach = F.lit(np.sqrt(2 - 2 * threshold) / 2) / F.sqrt("dim")  # half a standard deviation of a projected link
    done = [small]
    for level in range(LEVELS):
        if rest.isEmpty():
            break
        own = F.element_at(p, level + 1)
        q = F.percentile_approx(own, [0.25, 0.5 - forest.spill, 0.5, 0.5 + forest.spill, 0.75], 10_000)
        cuts = rest.groupBy(*at).agg(q.alias("q")).select(*at, F.col("q")[2].alias("mid"), F.greatest((F.col("q")[3] - F.col("q")[1]) / 2, reach).alias("band"), "q")
        tight = (F.col("mid") - F.col("q")[0] <= F.col("band")) | (F.col("q")[4] - F.col("mid") <= F.col("band"))
        side = lambda k: F.xxhash64("leaf", F.lit(2 * level + k))  # noqa: B023, E731
        both = F.array(F.when(own <= F.col("mid") + F.col("band"), side(0)), F.when(own > F.col("mid") - F.col("band"), side(1)))
        cut = rest.join(cuts.withColumn("tight", tight), at).withColumn("leaf", F.explode(F.when(F.col("tight"), F.array("leaf")).otherwise(F.array_compact(both))))
        cut = stage.write(cut.select("node", "dim", "leaf", "tight", "p"))
        stage.drop(rest)
        many = cut.groupBy(*at).agg(F.count("*").alias("m"))
        done.append(cut.where("tight").select("node", "dim", "leaf"))
        counted = stage.write(cut.where("NOT tight").join(many, at).select("node", "dim", "leaf", "p", (F.col("m") > split).alias("large")))
        done.append(counted.where("NOT large").select("node", "dim", "leaf"))
        rest = counted.where("large").select("node", "dim", "leaf", "p")
    done.append(rest.select("node", "dim", "leaf"))  # compared in blocks
    every = done[0]
    for f in done[1:]:
        every = every.unionByName(f)
    leaves = every.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    return stage.write(routed.drop("leaves").join(leaves, "node").select(*routed.columns))


SLAB = 256  # rows of a leaf that are compared with the others at once


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links in one leaf (or pair of its blocks): counts per node (b null), and a spanning forest (c null)."""
    leaf, b1, b2 = int(pdf["leaf"].iloc[0]), int(pdf["b1"].iloc[0]), int(pdf["b2"].iloc[0])
    none = pd.DataFrame({"a": pd.array([], "Int64"), "b": pd.array([], "Int64"), "c": pd.array([], "Int64")})
    x, own, many, block = unit(list(pdf["v"])), pdf["node"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), pdf["block"].to_numpy()
    n = len(x)
    # which smaller leaves is each row in? A pair that shares one counts there.
    earlier = [v[v < leaf] for v in map(np.asarray, pdf["leaves"])]
    columns = np.unique(np.concatenate(earlier))
    member = np.zeros((n, len(columns)), np.float32)
    for r, v in enumerate(earlier):
        member[r, np.searchsorted(columns, v)] = 1
    count, kept = np.zeros(n, np.int64), []
    for s in range(0, n, SLAB):
        cos = x[s : s + SLAB] @ x.T
        hit = cos >= threshold
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9), strict=True):  # decided alike wherever the pair meets
            low, high = sorted((s + i, j), key=lambda k: own[k])
            hit[i, j] = float((x[low] * x[high]).sum()) >= threshold
        hit &= np.arange(s, s + len(cos))[:, None] < np.arange(n)
        if b1 != b2:
            hit &= block[s : s + SLAB, None] != block
        kept.append(np.packbits(hit, axis=1))
        r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        hit[np.ix_(r, c)] &= member[s + r] @ member[c].T == 0
        count[s : s + SLAB] += hit @ many
        count += many[s : s + SLAB] @ hit
    label = own.copy()
    while True:
        low = label.copy()
        for k, bits in enumerate(kept):
            i, j = np.nonzero(np.unpackbits(bits, axis=1, count=n))
            i += k * SLAB
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
        if (low == label).all():
            break
        label = low
    has = np.flatnonzero(count > 0)
    edge = np.flatnonzero(label != own)
    return pd.concat([none, pd.DataFrame({"a": own[has], "b": None, "c": count[has].astype(np.int64)}), pd.DataFrame({"a": own[edge], "b": label[edge], "c": None})]).astype("Int64")


def near(vectors: DataFrame, stage: Stage, threshold: float = 0.95, trees: int = 10, leaf: int = 256, spill: float = 0.03, max_sample: int = 20_000, block: int = 2048, split: int = 2048, seed: int = 5) -> DataFrame:
    """vectors (vec_id, embedding) to id, n_links, component."""
    spark = vectors.sparkSession
    e = vectors["embedding"].cast("array<double>")
    valid = F.coalesce((F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    own = vectors.select(F.coalesce(vectors["vec_id"], F.lit(LAST)).alias("id"), F.when(valid, e).alias("e"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # -0.0 and 0.0 are one value
            raw = [None if v is None else (np.asarray(v, "<f8") + 0.0).tobytes() for v in pdf["e"]]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "v": raw})

    rows = stage.write(own.mapInPandas(pack, "id long, v binary"))
    nodes = stage.write(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    total = nodes.count()
    sample = [r.v for r in nodes.orderBy(F.xxhash64(F.lit(seed), "v")).select("v").limit(max_sample).collect()]
    depth = max(0, min(int(np.ceil(np.log2(max(1, total / leaf)))), int(np.log2(max(1, len(sample) / 8)))))
    forest = Forest(trees, depth, spill, seed)
    for dim in sorted({len(v) for v in sample}) if depth else ():
        forest.fit(unit([v for v in sample if len(v) == dim]))
    sent = spark.sparkContext.broadcast(vars(forest))  # trees * 2**depth thresholds, at most max_sample / 8 a tree

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = revive(Forest, sent.value)
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].str.len()):
                r, at = forest.route(unit(list(part["v"])))
                order = np.lexsort((at, r))
                r, at = r[order], at[order]
                cut = np.searchsorted(r, np.arange(1, len(part)))
                yield part.assign(dim=int(dim) // 8, leaves=np.split(at, cut))

    routed = stage.write(nodes.mapInPandas(route, "v binary, node long, copies long, dim int, leaves array<long>"))
    measured = lambda routed: routed.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").agg(F.count("*").alias("m"))
    sizes = stage.write(measured(routed))
    if not sizes.where(F.col("m") > split).isEmpty():
        routed = _refined(routed, sizes, stage, forest, threshold, split)
        sizes = measured(routed)
    sizes = sizes.where("m > 1")
    placed = routed.select("*", F.explode("leaves").alias("leaf"))
    placed = placed.join(sizes, ["dim", "leaf"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("v", F.lit(seed + 1)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other", "blocks", "m")
    found = placed.groupBy("dim", "leaf", "b1", "b2").applyInPandas(lambda pdf: _compare(pdf, threshold), "a long, b long, c long")
    found = stage.write(found)
    counts = found.where("c IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("c").alias("c"))
    labels = components(stage, found.where("b IS NOT NULL"), "a", "b").toDF("node", "component")
    done = nodes.join(counts, "node", "left").join(labels, "node", "left")
    done = done.select("v", (F.coalesce("c", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    single = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return rows.where("v IS NOT NULL").join(done, "v").select("id", "n_links", "component").unionByName(single)


def op5_vector_forest(spark, sf_dir: str) -> DataFrame:
    out = near(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), Stage(spark, "op5"))
    return out.select(F.nullif("id", F.lit(LAST)).alias("vec_id"), "n_links", F.nullif("component", F.lit(LAST)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
