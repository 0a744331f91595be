"""The data source, the table function, the sketches, and what scratch() deletes."""

import os

import pytest
from pyspark.sql import functions as F

from brindle.functions import tables
from brindle.operators.sketches import rolled_up, set_estimates, sketches
from brindle.session import keep, new_path, scratch, shared_dir
from brindle.sources import keyed


def saved(df, at, mode="append"):
    df.write.format(keyed.NAME).option("key", "k").mode(mode).save(at)


@pytest.fixture
def at(spark, tmp_path):
    keyed.register(spark)
    df = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    saved(df.repartitionByRange(8, "k"), str(tmp_path / "t"))
    return str(tmp_path / "t")


def opened(df):
    """Partitions that the scan makes: one for each file that it opens."""
    return df.rdd.getNumPartitions()


def test_files_out_of_range_are_not_opened(spark, at):
    every = keyed.load(spark, at, "k")
    assert opened(every) == 8 and every.count() == 1000
    few = keyed.load(spark, at, "k", 300, 319)
    assert opened(few) < 3 and sorted(r["k"] for r in few.collect()) == list(range(300, 320))
    assert few.where("k = 315").count() == 1 and few.where("v = 'v310' or k = 7").collect() == [(310, "v310")] and few.where("k > 310").count() == 9 and few.count() == 20
    assert keyed.load(spark, at, "k", low=990).count() == 10 and keyed.load(spark, at, "k", high=-1).count() == 0
    assert every.count() == 1000 and every.where("k = 7").count() == 1 and every.where("v = 'v7' or k = 8").count() == 2 and every.where("k is null").count() == 0


def test_a_failed_write_is_not_seen_and_overwriting_is(spark, at):
    bad = spark.range(5).select(F.col("id").alias("k"), F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="broken"):
        saved(bad.repartition(3), at)
    every = spark.read.format(keyed.NAME).option("key", "k")
    assert every.load(at).count() == 1000
    saved(spark.createDataFrame([(None, "n"), (3, None)], "k long, v string"), at)
    assert every.load(at).count() == 1002 and every.load(at).where("k is null").collect() == [(None, "n")]
    saved(spark.createDataFrame([(1, "only")], "k long, v string"), at, "overwrite")
    assert every.load(at).collect() == [(1, "only")]


def test_rises_by_key_in_order(spark):
    tables.register(spark)
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 3.0), ("a", 5, 3.0), ("a", 6, 4.0), ("a", 7, 9.0), (None, 2, 8.0), (None, 1, 7.0), ("b", 1, 1.0)]
    spark.createDataFrame(rows[::-1], "u string, t int, v double").createOrReplaceTempView("risen")
    got = spark.sql("select * from rises(table(risen), 'u', 't', 'v', 2)")
    assert got.schema["u"].dataType.simpleString() == "string"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 1, 2, 1.0, 2.0), ("a", 2, 3, 3.0, 9.0), (None, 1, 2, 7.0, 8.0)], key=repr)
    for args in ("'u', 't', 'none', 2", "'u', 't', 'v', 0"):
        with pytest.raises(Exception):
            spark.sql(f"select * from rises(table(risen), {args})").collect()


def test_sketches_stay_within_their_error(spark):
    df = spark.range(60_000).select(F.col("id").alias("v"), F.explode(F.array(F.lit("a"), F.when(F.col("id") % 3 == 0, "b"), F.when(F.col("id") < 20_000, "c"))).alias("g"), (F.col("id") % 7).alias("day")).where("g is not null")
    made = rolled_up(sketches(df, ["g", "day"], "v"), ["g"])
    got = {(r["a"], r["b"]): r for r in set_estimates(made, "g").collect()}
    exact = {("a", "b"): (60_000, 60_000, 20_000, 40_000), ("a", "c"): (60_000, 60_000, 20_000, 40_000), ("b", "c"): (20_000, 33_333, 6_667, 13_333)}
    for pair, want in exact.items():
        found = [got[pair][n] for n in ("in_a", "in_either", "in_both", "only_a")]
        assert all(abs(x - y) <= 4 / 64 * want[1] for x, y in zip(found, want))


def test_scratch_deletes_its_own_tables_only(spark):
    other = keep(spark.range(3))
    with scratch(spark):
        inside = keep(spark.range(5))
        path = new_path(spark)
        with scratch(spark):
            deeper = keep(spark.range(7)).inputFiles()[0]
        assert not os.path.exists(deeper.removeprefix("file://")) and inside.count() == 5
        spark.range(2).write.parquet(path)
        files = [inside.inputFiles()[0].removeprefix("file://"), path]
        assert all(map(os.path.exists, files)) and path.startswith(shared_dir(spark))
    assert not any(map(os.path.exists, files)) and other.count() == 3
