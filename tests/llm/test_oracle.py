"""The queries that SQL can express against their SQL in DuckDB, over whole tables: names, types and values."""

import duckdb
import pytest

from brindle.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        found.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df, sql = QUERIES[name](spark, DATA), db.sql(ORACLE_SQL[name])
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(sql.columns, map(str, sql.types)))
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[sql.columns.index(c)] for c in order) for r in sql.fetchall()), key=repr)
