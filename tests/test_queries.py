"""Every registered box query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from boxquery.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    at = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (round(float(v), 5) if isinstance(v, float) else v)
    return sorted((tuple(clean(r[k]) for k in at) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
