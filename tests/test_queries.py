"""Every query of the registry against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from parlance import config, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = db.execute(registry.SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_config_is_sound():
    assert config.validate() == []
