"""Every tabular query against its reference SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lumenframe.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


SMALL = {"train_additive_e2e"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SMALL))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    cursor = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
