"""Every registered query of the relational part against its SQL in DuckDB, names, types and values."""

import duckdb
import pytest

from brindle.plans import catalogue
from brindle.session import TABLES

DATA = "/root/testdata/sf0.001"
#: Names of the types in DuckDB by Spark's.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def rows(names, found):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    df, sql = catalogue.QUERIES[name](spark, DATA), db.sql(catalogue.ORACLE_SQL[name])
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == dict(zip(sql.columns, map(str, sql.types)))
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
