"""Operator 12 against every pair, on names with the awkward cases."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import name_join
from parlance.llm.common import Stage


def distance(a, b):
    """Optimal string alignment, by its definition."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def crc(x):
    return zlib.crc32(str(x).encode())


def misspelt(key, name):
    if key is None or not name or crc(key) % 2 or len(name) < 2:
        return name
    k = crc(key) % (len(name) - 1)
    return name[:k] + name[k + 1] + name[k] + name[k + 2 :]


def edited(rng, name, times):
    for _ in range(times):
        k = rng.randrange(len(name) + 1)
        name = rng.choice([name[:k] + rng.choice("abö😀") + name[k:], name[: max(0, k - 1)] + name[k:], name[: max(0, k - 1)] + rng.choice("xyz") + name[k:], name[: max(0, k - 2)] + name[k - 1 : k] + name[max(0, k - 2) : max(0, k - 1)] + name[k:]])
    return name


def tables():
    rng = random.Random(12)
    syllables = ["jo", "el", "an", "ma", "tan", "ham", "ström", "日本", "😀", " "]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 8))) for _ in range(60)] + ["", "a", "ab", "ba", "abc", "acb", "abcd", "abcde", "aaaaaaaaaaaa", "x" * 700, None]
    vendors = [(i, n) for i, n in enumerate(names)] + [(3, names[3]), (3, names[4]), (None, "abcd"), (None, names[0])]
    clients = [(1000 + i, edited(rng, n, rng.randrange(4))) for i, n in enumerate([n for n in names if n] * 6)]
    clients += [(i, names[0]) for i in range(300)] + [(None, names[0]), (None, "abdc"), (7, None), (8, ""), clients[5], clients[5]]
    return vendors, clients


def expected(vendors, clients):
    out = collections.defaultdict(list)
    for v, name in vendors:
        for c, other in clients:
            if name and other and abs(len(name) - len(other)) <= 2 and (d := distance(name, other)) <= 2:
                out[v, d].append(c)
    return {(v, d, len(ids), min((i for i in ids if i is not None), default=None), sum(crc(i) for i in ids if i is not None)) for (v, d), ids in out.items()}


@pytest.fixture(scope="module")
def made():
    return tables()


def test_join(spark, made):
    vendors = [(v, misspelt(v, n)) for v, n in made[0]]
    v = spark.createDataFrame([(*r, "s", "p") for r in vendors], "vendor_id long, name string, size string, part string").repartition(3)
    c = spark.createDataFrame([(*r, "s", "p") for r in made[1]], "client_id long, name string, client string, first string").repartition(3)
    got = {tuple(r) for r in name_join.join(v, c, Stage(spark, "t")).collect()}
    want = expected(vendors, made[1])
    assert got == want
    assert {d for _, d, *_ in want} == {0, 1, 2} and len(want) > 60
    assert not name_join.join(v.limit(0), c, Stage(spark, "t")).collect()
    assert not name_join.join(v, c.limit(0), Stage(spark, "t")).collect()


def test_misspelt(spark, made):
    rows = [(v, n) for v, n in made[0]]
    df = spark.createDataFrame(rows, "k long, n string")
    got = sorted(map(tuple, df.select("k", "n", name_join.misspelt(F.col("n"), F.col("k")).alias("m")).collect()), key=str)
    assert got == sorted(((k, n, misspelt(k, n)) for k, n in rows), key=str)
    assert any(n != m for _, n, m in got)


def test_alignment_is_exact_up_to_the_bound():
    rng = random.Random(1)
    names = ["".join(rng.choice("ab😀") for _ in range(rng.randrange(9))) for _ in range(400)]
    others = [edited(rng, n, rng.randrange(5)) for n in names]
    got = name_join.alignment(names, others, 2)
    assert [min(d, 3) for d in map(distance, names, others)] == [min(int(d), 3) for d in got]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]
    vendors = [(v, misspelt(v, n)) for v, n in read("vendors", "vendor_id", "name")]
    want = expected(vendors, read("clients", "client_id", "name"))
    assert {tuple(r) for r in name_join.op12_name_join(spark, folder).collect()} == want and want
