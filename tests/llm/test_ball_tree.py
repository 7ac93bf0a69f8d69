"""Operator 13 against exact assignment of every vector, and its filter against what it may drop."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import ball_tree
from parlance.llm.common import Stage

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id long"


def table(dim, seed=4):
    """Groups, copies, ties, and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [v + rng.gauss(0, 0.1) for v in centres[i % 5]]) for i in range(400)]
    rows += [(1000 + i, list(centres[0])) for i in range(150)] + [(i, rows[i][1]) for i in range(4)]
    rows += [((1 << 62) + 1, list(centres[1])), (None, list(centres[1])), (None, list(centres[2])), (2000, None), (2001, []), (2002, [0.0] * (dim - 1)), (2003, [float("nan")] * dim), (2004, [float("inf")] + [0.0] * (dim - 1)), (2005, [None] * dim), (2006, [0.0] * dim), (2007, [-0.0] * dim)]
    return [(i, e, 1, "x", 7) for i, e in rows]


def expected(rows, dim, k, rounds, scale=64, seed=1):
    kept = [(i, tuple(int(np.floor(float(np.float32(v)) * scale)) for v in e)) for i, e, *_ in rows if e is not None and len(e) == dim and all(v is not None and np.isfinite(v) for v in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(x) for _, x in sorted(kept, key=lambda r: (key(r)[0], key(r)[1] if r[0] is not None else "", r[1]))[:k]]
    for turn in range(rounds + 1):
        out = []
        for i, x in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(x, own, strict=True)), n) for n, own in enumerate(centroids))
            out.append((i, c, d, x))
        if turn < rounds:
            for c in range(len(centroids)):
                if mine := [x for _, n, _, x in out if n == c]:
                    centroids[c] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    return sorted(((i, c, d) for i, c, d, _ in out), key=str), centroids


@pytest.mark.parametrize(("dim", "k", "block"), [(8, 16, 100), (3, 5, 4096), (8, 3, 1)])
def test_against_every_vector(spark, dim, k, block):
    rows = table(dim)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, centroids = ball_tree.cluster(df, Stage(spark, "t"), k=k, rounds=3, dim=dim, block=block)
    want, means = expected(rows, dim, k, 3)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert centroids.tolist() == means


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0), (2, [1.0, 2.5], 0, "", 0)], SCHEMA)
    got, centroids = ball_tree.cluster(df, Stage(spark, "t"), k=16, dim=2)
    assert len(centroids) == 2 and {r.distance for r in got.collect()} == {0}
    got, centroids = ball_tree.cluster(df.limit(0), Stage(spark, "t"), k=16, dim=2)
    assert not got.collect() and centroids.shape == (0, 2)


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [s * 2.0**20 + i, 3.0 * i], 0, "", 0) for i, s in enumerate([1, -1, 1, -1, 0.5])]
    got, _ = ball_tree.cluster(spark.createDataFrame(rows, SCHEMA), Stage(spark, "t"), k=2, dim=2)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 2, 2, 3)[0]
    with pytest.raises(Exception, match="can't be clustered"):
        ball_tree.cluster(spark.createDataFrame([(1, [1e30, 0.0], 0, "", 0)], SCHEMA), Stage(spark, "t"), dim=2)


def test_balls_are_assigned_whole():
    """Far groups need no comparison at all; a vector between two centroids is compared; a tie goes to the smaller number."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-9, 9, (200, 4)) + 1000 * s for s in (-1, 1)])
    order, centre, radius, count, total = ball_tree.grown(x)
    assert count[0] == 400 and (total[0] == x.sum(axis=0)).all()
    y = x[order]
    whole, rows, _ = ball_tree.filtered(400, y, centre, radius, np.array([[-1000] * 4, [1000] * 4]))
    assert len(rows) == 0 and sorted((b - a, c) for _, a, b, c in whole) == [(200, 0), (200, 1)]
    _, rows, won = ball_tree.filtered(400, y, centre, radius, np.array([[5000] * 4, [1000] * 4, [1000] * 4]))
    assert len(rows) and set(won) == {1}


def test_query_is_whole(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(*r, 0, "", 0) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, means = expected(rows, 64, 16, 3)
    got = ball_tree.op13_ball_tree(spark, folder).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
