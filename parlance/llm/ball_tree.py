"""Centroid clustering by filtering balls of vectors.

Vectors become integers (floor of `scale` times each component). Every task packs the vectors that it reads into metric
trees of at most `block` vectors, once; a tree is one row of a written table, and no vector moves again. A node
splits its vectors at the median along the line between two that lie far apart, and holds the centre, radius, count
and integer sum of its ball.

In each round the trees meet the centroids level by level. A centroid that is farther from a ball's centre than the
nearest one by more than the ball's diameter can win none of its vectors (triangle inequality) and is dropped
for everything below. A ball with one centroid left is assigned whole: its count and sum are added. Leaves that
still have several compare their vectors with those exactly. Bounds are taken with a margin above the rounding of their
square roots, and equal distances never drop a centroid, so results equal exact assignment, ties to the smaller number
included. A task returns one row for each centroid and batch of trees; sums are exact integers.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part. Repeated rows
are vectors of their own. With fewer vectors than centroids there are as many centroids; equal centroids leave all to
the smaller number, and an empty one stays where it is. Null ids come last among equal or missing hashes, and equal ids
in the order of their components. Components of 2**27 and more (after scaling) are refused with an error: their squared
distances pass a long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

BOUND = 1 << 27  # of a component: then squared distances of 64 of them fit a long
EXACT = 1 << 21  # below this, sums of 64 products are exact in doubles as well, and matrix products are much faster
LEAF = 32
TREE = "n int, ids binary, known binary, own binary, centre binary, radius binary, count binary, sum binary"


def grid(embedding: Column, dim: int, scale: float) -> Column:
    """Integer components of vectors that count; null for others."""
    e = embedding.cast("array<double>")
    valid = (F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    small = F.forall(e, lambda v: F.abs(v) < BOUND / scale)
    ints = F.transform(e, lambda v: F.floor(v * scale).cast("int"))
    return F.when(valid, F.when(small, ints).otherwise(F.raise_error(F.lit(f"components of {BOUND} and more can't be clustered")).cast("array<int>")))


def levels(n: int) -> int:
    """Levels of splits below the root."""
    return max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))


def ranges(n: int) -> list[np.ndarray]:
    """For each level, where its nodes begin in the order of the tree, and where the last one ends: halves of halves."""
    out = [np.array([0, n])]
    for _ in range(levels(n)):
        edge = out[-1]
        middle = (edge[:-1] + edge[1:] + 1) // 2
        out.append(np.append(np.stack([edge[:-1], middle], axis=1).ravel(), edge[-1]))
    return out


def grown(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors in the tree; centre, radius, count and sum of its nodes, level by level from the root."""
    order, y = np.arange(len(x)), x.astype(np.float64)
    found = []
    steps = ranges(len(x))
    for level, edge in enumerate(steps):
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = order[a:b]
            total = x[own].sum(axis=0, dtype=np.int64)
            centre = total / max(1, b - a)
            away = np.sqrt(((y[own] - centre) ** 2).sum(axis=1))
            found.append((centre, away.max(initial=0.0), b - a, total))
            if level + 1 < len(steps):
                one = y[own[away.argmax()]]
                two = y[own[((y[own] - one) ** 2).sum(axis=1).argmax()]]
                order[a:b] = own[np.argsort(y[own] @ (two - one), kind="stable")]
    return order, *(np.array([f[i] for f in found]) for i in range(4))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def filtered(n: int, x: np.ndarray, centre: np.ndarray, radius: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Whole balls as (node, begin, end, centroid); the positions of the vectors that were compared, and their centroids."""
    c = centroids.astype(np.float64)
    whole, rows, won = [], [], []
    alive = np.ones((1, len(c)), bool)
    nodes, first = np.zeros(1, np.int64), 0
    steps = ranges(n)
    for level, edge in enumerate(steps):
        at = first + nodes
        # differences, as products would lose the digits that the bounds need
        d = np.sqrt(((centre[at][:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        near = np.where(alive, d, np.inf).min(axis=1)
        slack = 1e-9 * (1 + near + radius[at])
        alive &= d <= (near + 2 * radius[at] + slack)[:, None]
        one = alive.sum(axis=1) == 1
        for k in np.flatnonzero(one):
            a, b = edge[nodes[k]], edge[nodes[k] + 1]
            whole.append((int(at[k]), int(a), int(b), int(alive[k].argmax())))
        rest = np.flatnonzero(~one)
        if level + 1 == len(steps):
            for k in rest:
                a, b = edge[nodes[k]], edge[nodes[k] + 1]
                may = np.flatnonzero(alive[k])
                rows.append(np.arange(a, b))
                won.append(may[squared(x[a:b], centroids[may]).argmin(axis=1)])
        first += 1 << level
        nodes = np.stack([2 * nodes[rest], 2 * nodes[rest] + 1], axis=1).ravel()
        alive = np.repeat(alive[rest], 2, axis=0)
        if not len(nodes):
            break
    none = np.zeros(0, np.int64)
    return whole, np.concatenate(rows) if rows else none, np.concatenate(won) if won else none


def _tree(row, dim: int) -> tuple[np.ndarray, ...]:
    """own, centre, radius, count and sum of a written tree."""
    array = lambda name, kind, *shape: np.frombuffer(getattr(row, name), kind).reshape(*shape)
    return array("own", "<i4", row.n, dim).astype(np.int64), array("centre", "<f8", -1, dim), array("radius", "<f8", -1), array("count", "<i8", -1), array("sum", "<i8", -1, dim)


def plant(vectors: DataFrame, stage: Stage, block: int) -> DataFrame:
    """vectors (id, x) to written trees, each of vectors that one task reads."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, np.int32) for v in pdf["x"]])
        order, centre, radius, count, total = grown(x)
        ids, known = (pdf[c].to_numpy()[order] for c in ("id", "known"))
        raw = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
        return pd.DataFrame([(len(x), raw(ids, "<i8"), raw(known, "?"), raw(x[order], "<i4"), raw(centre, "<f8"), raw(radius, "<f8"), raw(count, "<i8"), raw(total, "<i8"))], columns=[c.split()[0] for c in TREE.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            while size >= block:
                every = pd.concat(held)
                yield packed(every.iloc[:block])
                held, size = [every.iloc[block:]], size - block
        if size:
            yield packed(pd.concat(held))

    # ids with nulls among them would pass through doubles
    flat = vectors.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "x")
    return stage.write(flat.mapInPandas(run, TREE))


def summed(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and s0, s1, ...: count and component sums of the vectors nearest to each centroid."""
    k, dim = centroids.shape
    names = [f"s{i}" for i in range(dim)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
            for row in pdf.itertuples():
                own, centre, radius, count, total = _tree(row, dim)
                whole, rows, won = filtered(row.n, own, centre, radius, centroids)
                for node, _, _, c in whole:
                    n[c] += count[node]
                    s[c] += total[node]
                np.add.at(n, won, 1)
                np.add.at(s, won, own[rows])
            has = np.flatnonzero(n)
            yield pd.DataFrame({"cluster": has.astype(np.int32), "n": n[has], **{c: s[has, i] for i, c in enumerate(names)}})

    parts = trees.drop("ids", "known").mapInPandas(run, ", ".join(["cluster int", "n long", *[f"{c} long" for c in names]]))
    return parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                own, centre, radius, _, _ = _tree(row, dim)
                whole, rows, won = filtered(row.n, own, centre, radius, centroids)
                cluster = np.zeros(row.n, np.int64)
                for _, a, b, c in whole:
                    cluster[a:b] = c
                cluster[rows] = won
                away = ((own - centroids[cluster]) ** 2).sum(axis=1)
                ids = pd.array(np.frombuffer(row.ids, "<i8").copy(), "Int64")
                ids[~np.frombuffer(row.known, "?")] = pd.NA
                yield pd.DataFrame({"id": ids, "cluster": cluster.astype(np.int32), "distance": away})

    return trees.select("n", "ids", "known", "own", "centre", "radius", "count", "sum").mapInPandas(run, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, stage: Stage, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, block: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, embedding) to id, cluster, distance, written; and the final centroids.

    The k centroids are all that the driver holds: one row each comes back from a round."""
    kept = vectors.select(vectors["vec_id"].alias("id"), grid(vectors["embedding"], dim, scale).alias("x")).where("x IS NOT NULL")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = kept.orderBy(h.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r.x for r in starts], np.int64).reshape(len(starts), dim)
    trees = plant(kept, stage, block)
    for _ in range(rounds):
        for r in summed(trees, centroids).collect() if len(centroids) else ():
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    out = stage.write(assigned(trees, centroids))
    stage.drop(trees)
    return out, centroids


def op13_ball_tree(spark, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out, centroids = cluster(own, Stage(spark, "op13"))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r.cluster: r.i for r in out.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}  # a row for each centroid
    at = lambda values: F.element_at(F.array(*map(F.lit, values or [None])), F.col("cluster") + 1)
    return out.select(
        F.col("id").alias("vec_id"), "cluster", "distance", at([inertia.get(i, 0) for i in range(len(hashes))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), at(hashes).cast("string").alias("centroid_sha256"),
    )


SCALE, DIM, K, ROUNDS = 64, 64, 16, 3


def _sql() -> str:
    """The same by comparing every vector with every centroid."""
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::double)::bigint) AS x FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIM})",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY h, x) - 1)::int AS cluster, x FROM (SELECT sha256('1:' || vec_id::varchar) AS h, x FROM kept ORDER BY h NULLS LAST, x LIMIT {K}))",
    ]
    for r in range(ROUNDS + 1):
        d = "list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
        parts.append(f"a{r} AS (SELECT vec_id, x, o.cluster, o.d AS distance FROM (SELECT k.vec_id, k.x, min(struct_pack(d := {d}, cluster := c.cluster)) AS o FROM (SELECT row_number() OVER () AS row, * FROM kept) k, c{r} c GROUP BY k.row, k.vec_id, k.x))")
        if r < ROUNDS:
            means = f"SELECT cluster, list(m ORDER BY i) AS x FROM (SELECT cluster, i, floor(sum(v)::double / count(*))::bigint AS m FROM (SELECT cluster, unnest(x) AS v, unnest(range({DIM})) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster"
            parts.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN ({means}) m USING (cluster))")
    final = f"SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::bigint AS cluster_inertia, sum(distance) OVER ()::bigint AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)"
    return f"WITH {', '.join(parts)} {final}"


SQL = _sql()
