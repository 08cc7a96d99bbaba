"""The registered corpus queries: reference SQL where there is any, shape elsewhere."""

import math
import os

import duckdb
import pytest

import corpus_pipeline
from lumenframe.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "source mixing", "byte bpe"]
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_pipeline_joins_documents_at_080(spark, docs):
    words = [f"word{i}" for i in range(300)]
    near = [f"other{i}" if i % 50 == 25 else w for i, w in enumerate(words)]  # 266 of 326 shingles: 0.82
    far = [f"else{i}" if i % 40 == 20 else w for i, w in enumerate(words)]  # 261 of 331 to the first: 0.79
    got = corpus_pipeline.unique_documents(spark, docs([" ".join(x) for x in (words, near, far)]), SF).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 2]
