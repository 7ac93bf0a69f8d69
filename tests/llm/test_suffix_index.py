"""Levels on shared storage: what later calls find of earlier ones, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import repeats, suffix_array
from parlance.llm.suffix_index import SuffixIndex

SPEC = repeats.Spec(window=60, k=29, w=32, words=False)


def batches():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, other, third = text(90), text(75), text(61)
    first = [(1, text(40) + passage + text(40)), (2, text(200)), (3, None), (4, ""), (5, text(30) + third)]
    second = [(6, text(10) + passage), (7, other + text(50) + other), (7, other + text(50) + other), (None, text(90))]
    third_ = [(8, third + text(20)), (9, other[5:] + text(9)), (10, text(80)), (1, first[0][1])]
    return [first, second, [], third_, [(11, passage[:60] + text(30)), (12, passage[:59] + text(30))]]


def expected(filed, rows, size):
    seen = {}
    for _, t in filed + rows:
        b = (t or "").encode()
        for j in range(len(b) - size + 1):
            seen[b[j : j + size]] = seen.get(b[j : j + size], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if seen[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        out.append((i, len(b), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [repeats.MOST, 0])
def test_later_calls_find_what_earlier_ones_filed(spark, tmp_path, most):
    filed, ranks, removed = [], [], []
    for rows in batches():
        index = SuffixIndex(spark, f"file://{tmp_path}/index", SPEC)  # opened anew: only what is stored is known
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = suffix_array.kept(index.add(docs, most)).select("doc_id", "n_bytes", "n_removed").collect()
        want = expected(filed, rows, SPEC.window)
        assert sorted(map(tuple, got), key=str) == want
        removed.append(sum(r[2] for r in want))
        filed += rows
        ranks.append([r for r, *_ in SuffixIndex(spark, f"file://{tmp_path}/index", SPEC).levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]] and removed[0] == 0 and all(removed[k] for k in (1, 3, 4))


def test_a_call_that_dies_leaves_the_state_before(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    first, second, *_ = batches()
    SuffixIndex(spark, path, SPEC).add(spark.createDataFrame(first, "doc_id long, text string"))
    docs = spark.createDataFrame(second, "doc_id long, text string")
    broken = SuffixIndex(spark, path, SPEC)
    monkeypatch.setattr(SuffixIndex, "_file", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        broken.add(docs)
    monkeypatch.undo()
    again = SuffixIndex(spark, path, SPEC)
    assert again.number == 0 and len(again.texts) == 1
    got = suffix_array.kept(again.add(docs)).select("doc_id", "n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == expected(first, second, SPEC.window)
    # what the dead call wrote, the merged levels and the old state go; what is in force stays
    assert again.vacuum() == 5 and SuffixIndex(spark, path, SPEC).levels == again.levels
    assert again.vacuum() == 0


def test_a_level_that_is_not_there_finds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first, second, *_ = batches()
    SuffixIndex(spark, path, SPEC).add(spark.createDataFrame(first, "doc_id long, text string"))
    index = SuffixIndex(spark, path, SPEC)
    index.levels = []
    got = index.add(spark.createDataFrame(second[:1], "doc_id long, text string"))
    assert got.where(F.col("spans").isNotNull()).isEmpty()
