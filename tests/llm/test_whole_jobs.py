"""Cases in which an operator once did less than its whole job, each against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from parlance.llm import jaccard_join, repeats, suffix_array, suffix_tree
from parlance.llm.common import Stage


def chains(count, length, words):
    """Groups in which each text differs from the one before in a word, so that only neighbours link."""
    rng = random.Random(5)
    texts = []
    for g in range(count):
        t = [f"g{g}w{i}" for i in range(words)]
        places = rng.sample(range(3, words - 3), length)
        for k, i in enumerate(places):
            texts.append(" ".join(t))
            t[i] = f"g{g}new{k}"
    return texts


def smallest(sets, percent):
    """For each set the smallest index reachable over links."""
    of = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and of[i] != of[j]:
            low, high = sorted((of[i], of[j]))
            of = [low if x == high else x for x in of]
    return of


def test_links_between_components_count_both_directions(spark):
    texts = chains(60, 6, 80)
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in map(str.split, texts)]
    want = smallest(sets, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.d: r.component for r in jaccard_join.join(docs, Stage(spark, "t"), size=3, percent=90, rounds=1).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) == 60


@pytest.mark.parametrize("most", [repeats.MOST, 0])
def test_null_ids_precede_nothing(spark, most):
    rng = random.Random(7)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    twice, inside, passage = make(90), make(60), make(70)
    rows = [(None, twice), (None, twice), (None, inside + make(20) + inside), (None, passage + make(15)), (None, make(25) + passage), (4, make(30) + passage), (9, passage + make(40)), (-3, make(80)), (None, make(70))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    order = lambda i: math.inf if i is None else i
    first = {}
    for i, w in rows:
        for j in range(len(w) - 49):
            first[tuple(w[j : j + 50])] = min(first.get(tuple(w[j : j + 50]), math.inf), order(i))
    want = Counter()
    for i, w in rows:
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < order(i) for k in range(j, j + 50)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    got = suffix_tree.kept(suffix_tree.dedup(docs, Stage(spark, "t"), most=most)).drop("kept").collect()
    assert Counter(map(tuple, got)) == want
    assert sorted(k[2] for k in want.elements()) == [0] * 6 + [70] * 3


def test_near_duplicates_drop_linked_rows_only(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    texts = [" ".join(make(60)) for _ in range(6)]
    copy = " ".join([*make(60)])
    close = copy.rsplit(" ", 1)[0] + " other"
    blank = [(None, None), (None, None), (None, ""), (None, " \n"), (6, ""), (6, "")]
    unlinked = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, "two words")]
    # of doc_id 5, one text is the near copy of document 2's, the other nobody's; null-id rows copy one another
    linked = [(2, copy), (5, close), (None, copy), (5, texts[5]), (None, "same"), (None, "same"), (8, "two words")]
    stay = [(2, copy), (5, texts[5]), (None, "same")]
    rows = [(i, t, "en", "s1", len(t or "")) for i, t in blank + unlinked + linked]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(blank + unlinked + stay)


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns named as the stages name theirs."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = make(51)
    texts = [make(40) + " " + passage, passage + " " + make(40), make(20) + " " + passage + " " + make(20), None, "", " \n", "x", make(9000), make(60), *[make(rng.randrange(10, 90)) for _ in range(40)]]
    rows = [(i, t, "en", None if i % 5 == 2 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, rows[1][1], None, None, None), (None, None, None, None, None), (8, make(30), "fr", "s0", 7)]
    more = [(*r, 1, 2, "k", "o", 0.5, 3) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, d long, rk long, key string, own string, score double, size long"
    return passage, rows, spark.createDataFrame(more, schema).repartition(3)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    passage, rows, docs = awkward(spark)
    spark.createDataFrame([(i, 0) for i in range(10)] + [(None, 1), (11, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = Counter(rows)

    def run(step, docs):
        out = step(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        return Counter(map(tuple, out.collect()))

    assert run(corpus_pipeline.toxic, docs) == given  # no toxic label on any row: all stay
    found = run(corpus_pipeline.passages, docs)
    assert Counter((r[0], r[2], r[3]) for r in found.elements()) == Counter((r[0], r[2], r[3]) for r in given.elements())
    holding = [r for r in found.elements() if passage in (r[1] or "")]
    assert [r[0] for r in holding] == [0]  # the first copy stays, the others go
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in found.elements())
    assert {r[1] for r in given if r[0] not in (1, 2, None)} <= {r[1] for r in found}  # clean texts stay whole, repeated rows too
    mixed = run(corpus_pipeline.mixed, docs)
    assert set(mixed) <= set(given) and len(mixed) > len(given) / 2
    out = corpus_pipeline.segmented(spark, docs, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    _, _, docs = awkward(spark)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.where("false"), str(tmp_path)).count() == 0
    everything = corpus_pipeline.toxic(spark, docs, str(tmp_path))  # no label at all: nothing is known to be toxic
    assert everything.count() == docs.count()


def passages():
    """Rows that share passages of 51 words and more in fewer than 400 bytes, in more, or within one text only."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    short, other, long = make(52), make(60), make(150)
    rows = [(1, make(20) + short + make(20)), (2, make(40) + short), (3, short + make(9) + short), (4, make(30)), (5, make(10) + long), (6, long + make(25)), (7, other + make(15) + other)]
    rows += [(8, long[:100]), (None, make(12) + short), (None, make(60)), (9, make(80)), (6, other), (9, None), (10, []), (2, make(5) + long)]
    return [(i, w if w is None else " ".join(w)) for i, w in [*rows, rows[1], rows[8]]]


def test_passages_of_fewer_bytes_than_the_window_are_counted(spark, tmp_path):
    rows = passages()
    order = lambda i: math.inf if i is None else i
    raw = [(t or "").encode() for _, t in rows]
    starts = lambda b, n: [b[j : j + n] for j in range(len(b) - n + 1)]
    seen, first = Counter(x for b in raw for x in starts(b, 400)), {}
    for (i, _), b in zip(rows, raw, strict=True):
        for x in starts(b, 200):
            first[x] = min(first.get(x, math.inf), order(i))
    want = Counter()
    for (i, _), b in zip(rows, raw, strict=True):
        gone = {k for j, x in enumerate(starts(b, 400)) if seen[x] > 1 for k in range(j, j + 400)}
        held = {k for j, x in enumerate(starts(b, 200)) if first[x] < order(i) for k in range(j, j + 200)}
        want[i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest(), len(held)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, suffix_array.op7_suffix_array(spark, str(tmp_path)).collect())) == want
    divided = suffix_array.kept(suffix_array.with_passages(docs, Stage(spark, "t"), most=0)).drop("kept")
    assert Counter(map(tuple, divided.collect())) == want
    assert sum(not k[2] and k[5] > 0 for k in want) >= 3 and sum(k[2] > 0 for k in want) >= 3
    none = docs.where("doc_id > 99")
    assert suffix_array.kept(suffix_array.with_passages(none, Stage(spark, "t"))).count() == 0
