"""Operator 11: equal to brute force where all leaves are searched, and its recall where they are not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import tree_search
from parlance.llm.common import Stage

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id long, node long"


def table():
    """Copies of one vector, ties, vectors of several lengths and norms, and rows that take no part."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(6) * (1 + i % 4)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(80)] + [(40, rows[40][1]), (40, rows[41][1]), (60, rows[60][1])]
    rows += [(2000 + i, [float(i % 3 == j) for j in range(6)]) for i in range(90)] + [(3000 + i, [1.0, float(i), -0.0]) for i in range(41)]
    rows += [(None, rows[20][1]), (None, [5.0] * 6), (4000, None), (4020, []), (4040, [0.0] * 6), (4060, [float("nan")] * 6), (4080, [float("inf")] * 6), (4100, [None] * 6), (4120, [7.0]), (4140, [3e38] * 5), (4160, [-3e38] * 5)]
    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], 1, "v", 5, 6) for i, e in rows]


def product(a, b):
    total = 0.0  # in order; sum() would compensate what rounding loses
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def expected(rows, k, every):
    kept = {(i, tuple(0.0 if x == 0 else x for x in e)) for i, e, *_ in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    out = set()
    for q in kept:
        if q[0] is not None and q[0] % every == 0:
            others = [(product(q[1], c[1]), c) for c in kept if c != q and len(c[1]) == len(q[1])]
            others.sort(key=lambda c: (-c[0], np.inf if c[1][0] is None else c[1][0], 0))
            out |= {(q[0], n + 1, c[0], s) for n, (s, c) in enumerate(others[:k])}
    return out


@pytest.mark.parametrize(("leaf", "block"), [(16, 1024), (64, 7)])
def test_all_leaves_equal_brute_force(spark, leaf, block):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = tree_search.nearest(df, F.expr("vec_id % 20 = 0"), Stage(spark, "t"), trees=3, leaf=leaf, block=block, least=10**9)
    got = {tuple(r) for r in got.collect()}
    want = expected(rows, 20, 20)
    assert {r[:2] + r[3:] for r in got} == {r[:2] + r[3:] for r in want}
    assert got == want


def test_recall_and_empty(spark):
    """On the given vectors, which are spread evenly, with thresholds of few samples and no least number."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    stage = Stage(spark, "t")
    got = tree_search.nearest(df, F.expr("vec_id % 20 = 0"), stage, leaf=32, least=0).collect()
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    asked = np.flatnonzero(ids % 20 == 0)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    true = {(ids[a], ids[c]) for a, row in zip(asked, np.argsort(-s, axis=1)[:, :20], strict=True) for c in row}
    found = {(r.query, r.id) for r in got}
    assert len(got) == len(true) and len(found & true) >= 0.9 * len(true)
    assert not tree_search.nearest(df.limit(0), F.expr("vec_id % 20 = 0"), stage).collect()
    assert not tree_search.nearest(df, F.lit(None).cast("boolean"), stage).collect()


def test_queue_takes_the_nearest_side_first():
    """One tree of one split: a query close to the threshold goes on to the other leaf, and stops where it has enough."""
    forest = tree_search.Trees(1, 1, 0, 1.0)
    forest.cuts[2] = (np.array([[[1.0, 0.0, 0.0]]]), np.array([[0.1]]))
    forest.sizes = {(2, 1): 3, (2, 2): 4}
    q = np.array([[1.0, 0.0], [-1.0, 0.0]])
    assert forest.search(q, 4) == [[2], [1, 2]]
    assert forest.search(q, 100) == [[2, 1], [1, 2]]


def to_python(plan) -> int:
    """Bytes that the plan, which has run, gave to Python."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return to_python(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return to_python(plan.plan())
    own = plan.metrics().get("pythonDataSent")
    below = plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(to_python(below.apply(i)) for i in range(below.size()))


def test_vectors_and_queries_come_once_for_a_group_of_leaves(spark):
    """Many small leaves: neither is repeated for each leaf, or for each pair of rows that meet."""
    x = np.random.default_rng(3).standard_normal((10_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    out = tree_search.nearest(df, F.expr("vec_id % 20 = 0"), Stage(spark, "t"), leaf=16)
    assert len(out.collect()) == 20 * 500
    assert to_python(out._jdf.queryExecution().executedPlan()) < 30 * x.nbytes


@pytest.mark.parametrize(("scale", "side"), [(1.0, 1024), (1.0, 31), (1e-30, 1), (1e30, 31), (1e150, 1024)])
def test_what_single_precision_leaves_out_is_not_among_the_best(scale, side):
    """Scores that differ in the last places of double precision, at lengths that single precision holds and does not hold."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    x = (base + 1e-9 * rng.standard_normal((500, 64))) * scale
    q = np.stack([base, rng.standard_normal(64)]) * scale
    exact = np.array([[product(a, b) for b in x.tolist()] for a in q.tolist()])
    order = np.argsort(-exact, axis=1, kind="stable")
    low = np.array([exact[0, order[0, 20]], -np.inf])
    best = tree_search.Best(21, side)
    leaf = np.arange(500) // 50
    best.meet(q, np.array([7, 9]), low, np.repeat([0, 1], 10), np.tile(np.arange(10), 2), x, tree_search.lengths(x).max(), leaf, np.arange(500), np.arange(500))
    query, score, ids, _ = best.shrink()
    for i, n in enumerate((7, 9)):
        assert ids[query == n].tolist() == order[i, :21].tolist()
        assert score[query == n].tolist() == exact[i, order[i, :21]].tolist()


def test_floor_counts_only_what_the_leaves_taken_hold():
    """Two leaves: a query that takes one of them gets the bound of its vectors alone, and none where it holds too few."""
    forest = tree_search.Trees(1, 1, 0, 1.0)
    x = np.array([[1.0, 0.0], [0.9, 0.0], [0.5, 0.0], [0.4, 0.0]])
    forest.known[2] = x, np.array([[1], [2], [2], [2]]), 1.0
    got = forest.floor(np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0]]), [[2], [1], [2, 1]], 2)
    assert got[1] == -np.inf and np.allclose(got[[0, 2]], [0.5, 0.9], atol=1e-11, rtol=0) and (got[[0, 2]] <= [0.5, 0.9]).all()


def test_many_equal_scores_are_held_a_few_at_a_time():
    """All vectors are as near: the smallest ids are found, and no more than the limit is held."""
    n = 30_000
    best = tree_search.Best(21)
    x = np.stack([np.ones(n), np.arange(n, 0, -1.0)], axis=1)
    q = np.repeat([[1.0, 0.0]], 40, axis=0)
    best.meet(q, np.arange(40), np.ones(40), np.arange(40), np.zeros(40, int), x, tree_search.lengths(x).max(), np.zeros(n, int), np.arange(n), np.arange(n)[::-1] % 29_989)
    assert best.size < 450_000
    query, score, ids, _ = best.shrink()
    assert ids.tolist() == sorted(np.arange(n)[::-1] % 29_989)[:21] * 40 and (score == 1).all() and query.tolist() == np.repeat(np.arange(40), 21).tolist()
