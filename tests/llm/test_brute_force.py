"""Each operator against a brute-force version of its contract, on a fixture with the awkward cases and small settings."""

import base64
import collections
import hashlib
import itertools
import math
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import context_tree, fingerprints, jaccard_join, mixing, pieces, repeats, suffix_array, suffix_tree, toxicity, vector_forest, warc
from parlance.llm.common import U64, Stage, components, mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, d long, key long, own string, score double"


def corpus():
    """Copies, near copies, shared passages, repeats within a text, nulls, blanks, ties and a long text."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "日本", "a b"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = make(160), make(70)
    texts = [" ".join(base), " ".join(base), " ".join(base).upper(), " ".join(base[:80] + ["new"] + base[81:]), " ".join(make(30) + passage + make(30)), " ".join(make(10) + passage + make(90)), "\t".join(passage + make(5) + passage), None, "", "  \n ", "one", "One", "two words", " ".join(make(2500)), "x" * 900, "z" + "x" * 450]
    texts += [" ".join(make(rng.randrange(3, 120))) for _ in range(20)]
    near = make(120)
    for _ in range(8):
        t = list(near)
        t[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, " ".join(base), "en", "s1", 0)]
    return [(*r, 1, 2, 3, "x", 0.5) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text):
    return (text or "").encode()


def bag(found=()):
    return collections.Counter(found)


def last(i):
    return math.inf if i is None else i


@pytest.mark.parametrize("most", [repeats.MOST, 9_000, 0])
def test_suffix_tree(spark, docs, rows, most):
    first = {}
    for r in rows:
        w = raw(r[1]).split()
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, math.inf), last(r[0]))
    want = bag()
    for r in rows:
        w = raw(r[1]).split()
        gone = set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < last(r[0]):
                gone.update(range(j, j + 50))
        rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[r[0], len(w), len(gone), hashlib.sha256(rest).hexdigest()] += 1
    got = suffix_tree.kept(suffix_tree.dedup(docs, Stage(spark, "t"), most=most)).drop("kept").collect()
    assert bag(map(tuple, got)) == want
    assert sum(k[2] for k in want) > 0


@pytest.mark.parametrize(("batches", "most"), [(4, repeats.MOST), (4, 60_000), (3, 0)])
def test_suffix_array(spark, docs, rows, batches, most):
    seen = bag(b[j : j + 400] for b in (raw(r[1]) for r in rows) for j in range(len(b) - 399))
    want = bag()
    for r in rows:
        b = raw(r[1])
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[r[0], len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()] += 1
    got = suffix_array.kept(suffix_array.dedup(docs, Stage(spark, "t"), batches=batches, most=most)).drop("kept").collect()
    assert bag(map(tuple, got)) == want
    assert sum(k[2] for k in want) > 900


def test_prefixes_are_as_long_as_their_groups_need(spark):
    """One phrase before 600 different ends and after 600 different beginnings, in groups of 40 that go on alike, beside a phrase of its own."""
    phrase, other = [f"p{i}" for i in range(30)], [f"o{i}" for i in range(30)]
    tail = lambda k, n: [f"t{k // 40}_{i}" for i in range(25)] + [f"u{k}_{i}" for i in range(n)]
    texts = [tail(k, 25) + phrase + tail(k, 25) for k in range(600)] + [tail(k, 25) + other + tail(k, 25) for k in range(3)]
    docs = repeats.keyed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    stage, spec = Stage(spark, "t"), suffix_tree.WINDOW
    a = stage.write(repeats.anchor_rows(docs, spec))
    found = stage.write(repeats.groups(repeats.entries(a)))
    contexts = stage.write(repeats.cut(docs, found.where("m > 1"), spec))
    assert contexts.groupBy("kh").count().agg(F.max("count")).first()[0] >= 300
    most = 100 * 2000
    fit, leaves = repeats.divided(stage, contexts, spec, most)
    sizes = [f.groupBy("prefix").agg(F.sum(F.length("context") + 16 * spec.window).alias("size")) for f in fit]
    assert len(fit) > 1 and all(s.where(F.col("size") > most).isEmpty() and not s.isEmpty() for s in sizes) and leaves is None or not leaves.isEmpty()
    assert max(len(r.context.split()) for r in fit[1].collect()) <= spec.window + 7  # trimmed to eight windows
    results = [bag(map(tuple, repeats.runs(stage, docs, stage.write(found), spec, m).withColumn("s", F.explode(F.sequence("s_lo", "s_hi"))).select("kh", "ch", "s", "first").collect())) for m in (repeats.MOST, most, 0)]
    assert results[0] == results[1] == results[2] and len(results[0]) > 600


def test_levels_decide_what_is_found(spark):
    """Prefix 1 is in batches 0 and 2, prefix 2 twice in batch 1: without the level, only prefix 2 is found."""
    batches = [[(1, 5), (3, 5)], [(2, 5), (2, 6)], [(1, 7), (4, 5)]]
    for lose, want in ((False, [1, 2]), (True, [2])):
        index = suffix_array.LogIndex(Stage(spark, "t"))
        for b in batches:
            if lose:
                index.levels.clear()
            index.add(spark.createDataFrame(b, "kh long, ch long"))
        assert sorted(r.kh for r in index.matches().collect()) == want
    assert [rank for rank, _ in index.levels] == [0]


def test_sampled_windows_need_a_fitting_k():
    with pytest.raises(ValueError):
        repeats.Spec(window=50, k=20, w=32, words=True)


def groups_of(items, linked):
    """Smallest id reachable, by brute force."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(items)), 2):
        if linked(items[i], items[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    best = {}
    for i, (key, _) in enumerate(items):
        best[find(i)] = min(best.get(find(i), math.inf), last(key))
    return [None if best[find(i)] == math.inf else best[find(i)] for i in range(len(items))]


@pytest.mark.parametrize(("size", "percent", "rounds", "block"), [(3, 90, 1, 3), (5, 80, 0, 4096)])
def test_jaccard_join(spark, docs, rows, size, percent, rounds, block):
    def shingles(text):
        w = raw(text).lower().split()
        return {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    items = [(r[0], shingles(r[1])) for r in rows]
    groups = groups_of(items, lambda a, b: bool(a[1] and b[1]) and 100 * len(a[1] & b[1]) >= percent * len(a[1] | b[1]))
    want = bag((k, len(s), g) for (k, s), g in zip(items, groups, strict=True))
    null = repeats.LAST
    found = jaccard_join.join(docs, Stage(spark, "t"), size=size, percent=percent, rounds=rounds, block=block).collect()
    assert bag((None if r.d == null else r.d, r.n_shingles, None if r.component == null else r.component) for r in found) == want
    assert len(set(groups)) < len(rows) - 5


def test_bitmaps_bound_what_two_sets_share():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(U64)) for n in (3, 200, 200, 5000)]
    sets += [np.unique(np.concatenate((sets[3][:4900], sets[1])))]
    end = np.cumsum([len(x) for x in sets])
    maps = np.frombuffer(b"".join(jaccard_join.bitmaps(np.concatenate(sets), end)), "<u8").reshape(len(sets), -1)
    i, j = np.triu_indices(len(sets), 1)
    true = [len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    found = jaccard_join.apart(maps, i, j)
    assert (found <= true).all() and found.max() > 150 and (jaccard_join.apart(maps, i, i) == 0).all()


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 1), (3, 4), (4, 3), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(Stage(spark, "t"), edges).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 6: 1, 1: 1, 3: 3, 4: 3}


@pytest.mark.parametrize(("block", "sample", "split"), [(2048, 20_000, 2048), (5, 20_000, 2048), (2048, 40, 24), (7, 40, 24)])
def test_vector_forest(spark, block, sample, split):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = [(i, (centres[i % 40] + rng.standard_normal(16) * (0.02 if i % 3 else 1.5)).tolist()) for i in range(400)]
    x += [(400, x[0][1]), (400, x[0][1]), (401, [2 * v for v in x[0][1]]), (402, None), (403, [0.0] * 16), (404, [float("nan")] * 16), (405, [None] * 16), (406, []), (407, [1e200] * 16), (408, [1.0] * 16), (409, [1.0] * 3), (None, x[1][1])]

    def unit(v):
        if not v or any(a is None or not math.isfinite(a) for a in v) or not any(v):
            return None
        v = np.array(v) / max(map(abs, v))
        return v / np.linalg.norm(v)

    items = [(i, unit(v)) for i, v in x]
    near = lambda a, b: a[1] is not None and b[1] is not None and len(a[1]) == len(b[1]) and float(a[1] @ b[1]) >= 0.95
    links = [sum(near(a, b) for j, b in enumerate(items) if j != i) for i, a in enumerate(items)]
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in x], "vec_id long, embedding array<double>, label int, node int").repartition(3)
    got = vector_forest.near(df, Stage(spark, "t"), leaf=32, max_sample=sample, block=block, split=split).collect()
    assert len(got) == len(x)
    assert sum(r.n_links for r in got) >= 0.98 * sum(links)
    most = collections.defaultdict(int)
    for (i, _), n in zip(items, links, strict=True):
        most[repeats.LAST if i is None else i] = max(most[repeats.LAST if i is None else i], n)
    assert all(r.n_links <= most[r.id] for r in got)
    component = {r.id: r.component for r in got}
    assert component[400] == component[401] == component[0] and component[407] == component[408] == 407
    assert all(component[i] == i for i in (402, 403, 404, 405, 406, 409))


def test_fingerprints(spark, docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    text = [r[1] or "" for r in order]

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    want, close = bag(), {}
    for i, r in enumerate(order):
        after = text[(i + 1) % len(order)]
        third = len(text[i]) // 3
        e = text[i][: len(text[i]) - third] + after[:third]
        want[r[0], len(text[i]), hashlib.sha256(e.encode()).hexdigest()] += 1
        close.setdefault((r[0], hashlib.sha256(e.encode()).hexdigest()), (jaccard(shingles(text[i]), shingles(e)), jaccard(shingles(text[i]), shingles(after))))
    got = fingerprints.chain(docs).collect()
    assert bag((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    errors = [abs(r.near_edited - close[r.doc_id, r.edited_sha256][0]) for r in got]
    assert np.mean(errors) < 0.05
    by = collections.defaultdict(set)
    for r in got:
        by[r.n_chars if r.n_chars in (len(text[0]),) else (r.doc_id, r.n_chars)].add(r.fingerprint)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[0] == same[1] == same[None] and same[8] == "" and len(base64.b64decode(same[0])) == 256
    alone = fingerprints.chain(docs.where("doc_id = 0")).first()
    assert alone.near_next == 1.0


def test_densification_is_unbiased():
    rng = random.Random(5)
    errors = []
    for _ in range(60):
        a = [str(rng.random()) for _ in range(40)]
        b = a[:25] + [str(rng.random()) for _ in range(15)]
        fp, some = fingerprints.fingerprints([" ".join(a).encode(), " ".join(b).encode()])
        sa, sb = ({tuple(x[j : j + 5]) for j in range(36)} for x in (a, b))
        errors.append(float(fingerprints.likeness(fp[:1], fp[1:], some[:1], some[1:])[0]) - len(sa & sb) / len(sa | sb))
    assert abs(np.mean(errors)) < 0.03


def test_mixing(spark, docs, rows):
    got = mixing.plan(docs, Stage(spark, "t")).collect()
    source, size = {}, collections.Counter()
    for r in rows:
        n = len(raw(r[1]).split())
        size[r[3]] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    while True:  # reshare until no target is above its cap
        level = (sum(size.values()) - sum(3.0 * size[s] for s in set(order) - open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3.0 * size[s]}
        if not over:
            break
        open_ -= over
    target = {s: level * weight[s] if s in open_ else 3.0 * size[s] for s in order}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    of = {(r[0], len(raw(r[1]).split())): r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
    longest = {s: max(len(raw(r[1]).split()) for r in rows if r[3] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in order)
    assert bag(map(tuple, got)) == bag(map(tuple, mixing.plan(docs.repartition(2), Stage(spark, "t")).collect()))
    mixed = mixing.mix(docs, Stage(spark, "t"))
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_without_words(spark, docs):
    got = mixing.plan(docs.where("text IS NULL"), Stage(spark, "t")).collect()
    assert [r.taken for r in got] == [0]


def test_segmentation_is_lossless_and_reproducible(spark, docs, rows):
    p = pieces.Pieces()
    got = {(r.doc_id, r.n_pieces): r for r in pieces.segment(docs, p).collect()}
    again = {(r.doc_id, r.n_pieces): r for r in pieces.segment(docs.repartition(1), p).collect()}
    assert got.keys() == again.keys() and all(got[k].pieces == again[k].pieces for k in got)
    texts = {(r[0], r[1] or "") for r in rows}
    assert {(r.doc_id, r.decoded.decode()) for r in got.values()} <= texts and all(r.lossless for r in got.values())


def test_sampling_does_not_depend_on_the_batch_and_any_character_comes_back():
    p = pieces.Pieces()
    rng = random.Random(8)
    texts = ["a\0b", "\0", "\U0010ffff\ufffe", "日本 語\n\n é", *["".join(rng.choice("abcdeé \n\0") for _ in range(60)) for _ in range(300)]]
    keys = mix(np.arange(len(texts), dtype=U64))
    whole, one = pieces.Sampler(p), pieces.Sampler(p)
    at_once = whole.sample(texts, keys, 3)
    for i, t in enumerate(texts):
        assert (one.sample([t], keys[i : i + 1], 3)[0] == at_once[i]).all()
        assert whole.decode(at_once[i]) == t.encode()
    edge = {x: whole.cum[whole.ptr[whole.end[k]] :][:3].tolist() for x, k in whole.known.items()}
    assert all(one.cum[one.ptr[one.end[k]] :][:1].tolist() == edge[x][:1] for x, k in one.known.items())


def test_segmentation_follows_the_lattice():
    p = pieces.Pieces()

    def paths(s):
        if not s:
            yield (), 0.0
        for j in range(1, len(s) + 1):
            if s[:j] in p.ids:
                for rest, w in paths(s[j:]):
                    yield (p.ids[s[:j]][0], *rest), w + p.ids[s[:j]][1]

    every = dict(paths(" hello"))
    total, n = sum(map(math.exp, every.values())), 20_000
    keys = mix(np.arange(n, dtype=U64))
    seen = bag(tuple(x.tolist()) for x in pieces.Sampler(p).sample(["hello"] * n, keys, 3))
    assert set(seen) <= set(every)
    for path, w in every.items():
        expect = n * math.exp(w) / total
        assert abs(seen[path] - expect) < 5 * math.sqrt(expect + 1)


@pytest.mark.parametrize("together", [64, 2])
def test_context_tree_base_and_normalisation(spark, docs, rows, together):
    held = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(7)) == 2
    got = context_tree.score(docs.repartition(7), held, Stage(spark, "t"), parts=3, together=together).collect()
    c = collections.Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            c.update(raw(r[1]).lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = bag()
    for r in rows:
        w = [*raw(r[1]).lower().split(), None]
        want[r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # the whole corpus in one tree
    texts = context_tree.canonical([raw(r[1]) for r in rows])
    learn = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    keys, begin = context_tree.grams(texts)
    found, at = np.unique(keys, return_inverse=True)
    tree = context_tree.Tree(found, np.bincount(at, np.repeat(np.array(learn, float), [len(t) for t in texts])), top=0)
    logs = np.log10(tree.predict()[0]).sum(axis=1)
    want = bag((r[0], round(x, 2)) for r, x in zip(rows, np.add.reduceat(logs[at], begin).tolist(), strict=True))
    assert bag((r.doc_id, round(r.score, 2)) for r in got) == want


def test_context_tree_by_recursion():
    """The mixture of one tree against a plain recursive one, on short strings."""
    text = b"abracadabra abra cadabra\n"
    keys, _ = context_tree.grams([text])
    found, times = np.unique(keys, return_counts=True)
    tree = context_tree.Tree(found, times.astype(float), top=0)
    mixed, seen = tree.predict()
    padded = context_tree.PAD + text
    data = [(padded[i - 5 : i][::-1], padded[i]) for i in range(5, len(padded))]  # the last byte of context first

    def counts(context, path):
        n = [0, 0]
        for c, s in data:
            bits = f"1{s:08b}"
            k = len(bin(path)) - 2
            if c.startswith(context) and int(bits[:k], 2) == path:
                n[int(bits[k])] += 1
        return n

    def evidence(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def weighted(context, path):
        own = evidence(counts(context, path))
        if len(context) == context_tree.DEPTH:
            return own
        nexts = {c[: len(context) + 1] for c, _ in data if c.startswith(context)}
        return float(np.logaddexp(own, sum(weighted(x, path) for x in nexts if sum(counts(x, path))))) - math.log(2)

    def predict(context, path, bit, depth=0):
        n = counts(context[:depth], path)
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if depth == context_tree.DEPTH or not sum(counts(context[: depth + 1], path)):
            return own
        w = math.exp(evidence(n) - math.log(2) - weighted(context[:depth], path))
        return w * own + (1 - w) * predict(context, path, bit, depth + 1)

    for context, s in data[:6]:
        key = np.int64(int.from_bytes(context + bytes([s]), "big"))
        at = int(np.searchsorted(found, key))
        for b in range(8):
            path, bit = (1 << b) | (s >> (8 - b)), (s >> (7 - b)) & 1
            assert mixed[at, b] == pytest.approx(predict(context, path, bit), rel=1e-9)


def test_large_leaves_are_split_on_but_near_copies_stay_together(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    x = [(i, rng.standard_normal(32).tolist()) for i in range(1500)] + [(2000 + i, (centre + rng.standard_normal(32) * 0.05).tolist()) for i in range(300)]
    stage = Stage(spark, "t")
    seen = []
    write = stage.write

    def noted(df):
        out = write(df)
        if "leaves" in df.columns:
            seen.append(out)
        return out

    stage.write = noted
    got = {r.id: r for r in vector_forest.near(spark.createDataFrame(x, "vec_id long, embedding array<double>"), stage, leaf=32, max_sample=32, split=150, block=64).collect()}
    assert len(got) == 1800 and len(seen) == 2  # routed by the sample, then on
    assert all(got[i].n_links == 299 and got[i].component == 2000 for i in range(2000, 2300))
    assert all(got[i].n_links == 0 for i in range(1500))
    plain, held = [], set()  # members by leaf; leaves that hold near copies
    for routed in seen:
        members = collections.defaultdict(list)
        for r in routed.collect():
            for at in r.leaves:
                members[at].append(r.node)
        held = {at for at, who in members.items() if max(who) >= 2000}
        plain.append(max(len(who) for at, who in members.items() if at not in held))
        whole = max(sum(i >= 2000 for i in members[at]) for at in held)
    assert plain[0] > 150 >= plain[1] and whole == 300


def plain_features(text):
    words = "".join(" " if c in string.punctuation else c.lower() if c.isascii() else c for c in text).split()
    out = {("w", w) for w in words} | {("2", *p) for p in itertools.pairwise(words)} | {("s", *p) for p in zip(words, words[2:], strict=False)}
    return out | {("b", w[:k]) for w in words for k in toxicity.STEMS if len(w) > k}


def test_toxicity_features_by_sets():
    rng = random.Random(5)
    texts = ["", "One", "one, ONE! one", "a-b  c\td", "overlooking overlooked"] + [" ".join(rng.choice(["vile", "Thing.", "longer-words", "overlooking", "x"]) for _ in range(rng.randrange(40))) for _ in range(50)] + ["word " * 100_000]
    doc, slot = toxicity.features([t.encode() for t in texts])
    found = [set(slot[doc == i].tolist()) for i in range(len(texts))]
    want = [plain_features(t) for t in texts]
    assert [len(f) for f in found] == [len(w) for w in want]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(found[a] & found[b]) == len(want[a] & want[b])


def test_ftrl_by_plain_steps():
    rng = random.Random(6)
    data = [(sorted(rng.sample(range(30), rng.randrange(8))), rng.randrange(2)) for _ in range(200)]
    model = toxicity.Ftrl(l1=0.3)
    z, n, bz, bn = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= 0.3:
            return 0.0
        return -(z[i] - math.copysign(0.3, z[i])) / ((1 + math.sqrt(n[i])) / 1 + 0.1)

    for slots, y in data:
        model.learn(np.array(slots, np.int64), y)
        b = -bz / (1 + math.sqrt(bn))
        ws = {i: weight(i) for i in slots}
        g = 1 / (1 + math.exp(-(b + sum(ws.values())))) - y
        for i in slots:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) * ws[i]
            n[i] += g * g
        bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) * b
        bn += g * g
    assert model.weights(np.arange(30)) == pytest.approx([weight(i) for i in range(30)]) and model.bias() == pytest.approx(-bz / (1 + math.sqrt(bn)))
    kept = np.count_nonzero(model.weights(np.arange(30)))
    model.restrict(5)
    assert kept > 5 == np.count_nonzero(model.weights(slice(None)))


def test_toxicity_on_awkward_rows(spark):
    rows = [(i, "vile words here" if i % 2 else "kind words here", 9.0, "x", i) for i in range(60)] * 2 + [(None, "vile", 1.0, "x", 1), (70, "kind " * 50_000, 1.0, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string, h long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, label int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all((r.score > 0.5) == r.text.startswith("vile") for r in got)
    assert len({(r.text, r.score) for r in got}) == 4  # equal texts score alike


def test_toxicity_learns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(30)) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]] + [(401, None), (999, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "text"]).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows[400:])
    assert right >= 196 and got[900] == got[901] < toxicity.THRESHOLD
    few = toxicity.fit(docs, labels, max_rows=50)
    assert toxicity.fit(docs, labels.where("false"))[2] == 0.0 and len(few[0]) <= 1 << 17


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", '<html lang="en"><title>T  t</title><script>x<p></script><p>Hi &amp;lt; <b>you</b><!-- c --><a href="/l">z</a>'), (2, None, None), (1, "http://b/", "")], "page_id long, url string, html string")
    responses = warc.responses(pages)
    got = warc.derive(responses).collect()
    ids = {r.record_id for r in responses.collect()}
    assert len(got) == 6 and {r.refers_to for r in got} == ids and len({r.record_id for r in got}) == 6
    text = next(r for r in got if r.target_uri == "http://a/" and r.warc_type == "conversion")
    assert text.block == "Hi &lt; youz" and text.content_length == len(text.block.encode())
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    assert f"WARC-Refers-To: {text.refers_to}\r\n" in text.header and "WARC-Target-URI: http://a/" in text.header
    meta = next(r for r in got if r.target_uri == "http://a/" and r.warc_type == "metadata")
    assert "title: T t\r\n" in meta.block and "outlink: /l\r\n" in meta.block and "language: en" in meta.block


def test_warc_on_awkward_rows(spark):
    pages = spark.createDataFrame([(None, None, None, "m", "b"), (1, "u", "<p>" + "long " * 300_000 + "</p>", "m", "b"), (2, "u", "", "m", "b"), (2, "u", "", "m", "b")], "page_id long, url string, html string, header string, block string")
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 8
    text = next(r for r in got if r.warc_type == "conversion" and r.content_length > 1_000_000)
    assert text.block.split() == ["long"] * 300_000


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a &copy; b &eacute;&Eacute; &middot;", "a © b éÉ ·"), ("&#233;&#xE9;&#X1F600;", "éé😀"), ("&amp;lt; &#38;lt; &amp;amp;", "&lt; &lt; &amp;"), ("a&nbsp;&#160;&#xa0;b", "a b"),
        ("&nosuch; &amp &; & &#; &#x; &#xZZ; &#12345678;", "&nosuch; &amp &; & &#; &#x; &#xZZ; &#12345678;"), ("&#0;&#xD800;&#1114112;", "\ufffd\ufffd\ufffd"), ("<p>1<p>2<br>3", "1\n2\n3"), ("&lt;p&gt;&apos;&quot;", "<p>'\""), ("x&", "x&"),
    ],
)
def test_plain_texts_by_hand(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(warc.plain_text(F.col("h")).alias("t")).first().t == want


def test_warc_works_out_each_text_once(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>a &amp; &copy;</p>")], "page_id long, url string, html string")
    plan = warc.derive(warc.responses(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (warc.STEPS[0][0], warc.STEPS[-1][0], warc.TITLE, warc.LINK)] == [1, 1, 1, 1]


def test_warc_titles_and_links_stay_on_their_lines(spark):
    pages = spark.createDataFrame([(1, "u", '<title>a&#10;b &euro;</title><a href="/x?a=1&amp;b=2&#13;&#10;c">z</a>')], "page_id long, url string, html string")
    meta = warc.derive(warc.responses(pages)).where("warc_type = 'metadata'").first().block
    assert "title: a b €\r\n" in meta and "outlink: /x?a=1&b=2c\r\n" in meta


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files_are_read_as_written(spark, tmp_path, compression):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'é' * i}\r\n\r\nWARC-Type: no</p>\r\n") for i in range(50)] + [(99, None, None)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages)).repartition(3)
    warc.write_warc(made, f"{tmp_path}/w", compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        read = warc.read_warc(spark, f"{tmp_path}/w")
        got = {r.record_id: r for r in read.collect()}
        assert compression == "gzip" or read.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = made.collect()
    assert len(got) == len(want) == 102
    for r in want:
        x = got[r.record_id]
        assert bytes(x.block) == r.block.encode() and x.whole and x.warc_type == r.warc_type and x.refers_to == r.refers_to and x.target_uri == r.target_uri
        assert x.headers == r.header.split("\r\n")[1:-1]


def test_warc_responses_of_a_file_keep_headers_and_digest(spark, tmp_path):
    body = "<title>t</title><p>caf\u00e9".encode() + b"\xff"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    record = lambda head, block: b"\r\n".join([b"WARC/1.0", *head, b"Content-Length: %d" % len(block), b"", block, b"", b""])
    own = [b"WARC-Type: response", b"warc-record-id: <urn:uuid:1>", b"WARC-Target-URI: http://a/?x=y:z", b"WARC-Date: 2020-02-02T02:02:02Z", b"WARC-Payload-Digest: sha1:ABC", b"X-Own: 1"]
    odd = record([b"WARC-Type: resource", b"WARC-Record-ID: <urn:uuid:3>"], b"x\r\n\r\nWARC/1.0 inside")
    with open(f"{tmp_path}/a.warc", "wb") as f:
        f.write(record([b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:0>"], b"") + record(own, http) + odd)
    read = warc.read_warc(spark, f"{tmp_path}/a.warc")
    assert sorted((r.warc_type or "", r.whole) for r in read.collect()) == [("", False), ("resource", False), ("response", True), ("warcinfo", True)]
    found = warc.responses_of(read)
    r = found.first()
    assert (r.record_id, r.target_uri, r.date, r.payload_digest, r.payload) == ("<urn:uuid:1>", "http://a/?x=y:z", "2020-02-02T02:02:02Z", "sha1:ABC", body.decode(errors="replace"))
    got = {x.warc_type: x for x in warc.derive(found).collect()}
    assert "source-header: X-Own: 1\r\n" in got["metadata"].block and got["conversion"].block == "café\ufffd"
    assert all(x.refers_to == "<urn:uuid:1>" and x.source_payload_digest == "sha1:ABC" and "WARC-Date: 2020-02-02T02:02:02Z" in x.header for x in got.values())


def test_empty_tables(spark, empty):
    stage = Stage(spark, "t")
    assert suffix_tree.kept(suffix_tree.dedup(empty, stage)).count() == 0
    assert suffix_array.kept(suffix_array.dedup(empty, stage)).count() == 0
    assert suffix_array.cleaned(empty, stage).count() == 0
    assert jaccard_join.join(empty, stage).count() == 0
    assert mixing.plan(empty, stage).count() == 0 and mixing.mix(empty, stage).count() == 0
    assert fingerprints.chain(empty).count() == 0
    assert pieces.segment(empty, pieces.Pieces()).count() == 0
    assert context_tree.score(empty, F.lit(False), stage).count() == 0
    assert vector_forest.near(spark.createDataFrame([], "vec_id long, embedding array<float>"), stage).count() == 0
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, label int"))
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
