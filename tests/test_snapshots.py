"""Snapshot tables: versions, changes by key, failed and rival writes."""

import pytest
from pyspark.sql import functions as F

from brindle.session import table
from brindle.sources.snapshots import Snapshots

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def made(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (None, 1, "c"), (3, 3, "d")], "k long, j int, v string")
    return Snapshots.create(df, str(tmp_path / "t"), ["k", "j"], 4)


def test_versions_stay_readable(spark, made):
    first = rows(made.read())
    changes = spark.createDataFrame([("A", 1, None, False), ("C", None, 1, None), ("new", 9, 9, False), (None, 3, 3, True)], "v string, k long, j int, gone boolean")
    assert made.upsert(changes, "gone") == 1
    assert rows(made.read()) == sorted([(1, None, "A"), (2, 1, "b"), (None, 1, "C"), (9, 9, "new")], key=repr)
    assert rows(made.read(0)) == first and made.versions() == [0, 1]
    made.forget(1)
    assert made.versions() == [1] and len(rows(made.read())) == 4
    with pytest.raises(ValueError):
        made.read(0)


def test_only_touched_buckets_are_written(spark, made):
    before = made.manifest()["folders"]
    made.upsert(spark.createDataFrame([(2, 1, "B")], "k long, j int, v string"))
    after = made.manifest()["folders"]
    assert sum(after[b] != f for b, f in before.items()) == 1


def test_a_failed_write_leaves_the_old_version(spark, made):
    first = rows(made.read())
    bad = spark.createDataFrame([(2, 1, "B")], "k long, j int, v string").withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        made.upsert(bad)
    twice = spark.createDataFrame([(2, 1, "B"), (2, 1, "b")], "k long, j int, v string")
    with pytest.raises(ValueError):
        made.upsert(twice)
    assert made.versions() == [0] and rows(made.read()) == first


def test_the_second_of_two_writers_is_refused(spark, made):
    change = spark.createDataFrame([(2, 1, "B")], "k long, j int, v string")
    made.upsert(change)
    with pytest.raises(RuntimeError):
        made._publish(1, made.manifest())
    assert rows(made.read())[-1] == (None, 1, "c") and made.versions() == [0, 1]


def test_a_batch_counts_once(spark, made):
    change = spark.createDataFrame([(2, 1, "B")], "k long, j int, v string")
    assert [made.upsert(change, batch=0), made.upsert(change.withColumn("v", F.lit("x")), batch=0), made.upsert(change, batch=1)] == [1, 1, 2]


def test_all_rows_may_go(spark, made):
    made.upsert(made.read().withColumn("gone", F.lit(True)), "gone")
    assert rows(made.read()) == [] and len(rows(made.read(0))) == 4
    made.upsert(table(spark, DATA, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("j"), F.lit("o").alias("v")))
    assert made.read().count() == 1500
