"""Running values in blocks against the window form; how a hot key is spread."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators.joins import asof_join
from brindle.operators.scan import Blocks, global_ranks
from brindle.operators.windows import forward_fill, sessions
from brindle.session import table

DATA = "/root/testdata/sf0.001"
MANY = 40


@pytest.fixture(scope="module")
def rows(spark):
    """Nine rows in ten have one key; null keys, values and times; ties in time."""
    rng = random.Random(1)
    made = [(rng.choice([None, 2, 3]) if i % 10 == 0 else 1, rng.choice([None, *range(300)]), i, rng.choice([None, 1, 5, 9])) for i in range(2000)]
    return spark.createDataFrame(made, "k int, t int, id int, v long").cache()


def found(df):
    return sorted(df.collect(), key=repr)


def test_scan_equals_windows(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("k", "t", "id", "v", F.last("v", True).over(upto).alias("a"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("s"), F.lag("v").over(w).alias("p"))
    for most in (MANY, 10_000):
        got = Blocks.of(rows, ["k"], ["t", "id"], most).scan(last={"a": "v"}, sums={"s": "v"}, previous={"p": "v"}).done()
        assert found(got.select(*want.columns)) == found(want)
    assert Blocks.of(rows.limit(0), ["k"], ["t", "id"], 1).scan(last={"a": "v"}).done().count() == 0


def test_a_hot_key_is_spread_evenly(spark, rows):
    """The sizes of the tasks that run the windows, and of the written blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = Blocks.of(rows, ["k"], ["t", "id"], 200).scan(last={"a": "v"})
        sizes = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("a")).collect()]
        per_task = sizes(got.rows)
        plain = sizes(rows.select("*", F.last("v", True).over(Window.partitionBy("k").orderBy("t", "id")).alias("a")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(plain) >= 1800 and max(per_task) <= 700
    blocks = [r["count"] for r in got.rows.where("__block >= 0").groupBy("__block").count().collect()]
    assert len(blocks) >= 15 and max(blocks) <= 200


def test_small_blocks_are_not_as_many_tasks(spark):
    df = spark.range(4000).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.pmod(F.col("id") * 7919, F.lit(4001)).alias("t"), F.col("id").alias("v"))
    got = Blocks.of(df, ["k"], ["t"], 20)
    assert len(got.rows.where("__block >= 0").inputFiles()) <= 4  # as many as Spark shuffles into here
    sizes = [r["count"] for r in got.rows.groupBy("__block", "k").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 10
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("p"))
    assert found(got.scan(sums={"s": "v"}, previous={"p": "v"}).done().select("k", "t", "s", "p")) == found(want)


def test_asof_looks_once_for_each_time(spark, monkeypatch):
    """Many rows of few times: what is put in order is as many rows as there are times."""
    left = spark.range(6000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7 * 10).alias("t"), "id")
    right = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 5 * 10 + 5).alias("rt"), F.col("id").alias("v"))
    ordered, of = [], Blocks.of
    monkeypatch.setattr(Blocks, "of", staticmethod(lambda df, *rest: ordered.append(df.count()) or of(df, *rest)))
    got = asof_join(left, right, ["k"], "t", "rt", ["v"], 10).collect()
    best = {}
    for i in range(3000):
        best[i % 2, i % 5 * 10 + 5] = i
    want = [(i % 2, i % 7 * 10, i, best.get((i % 2, max((t for t in (5, 15, 25, 35, 45) if t <= i % 7 * 10), default=None)))) for i in range(6000)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert ordered == [2 * 7 + 2 * 5]


def test_asof_null_times_match_nothing(spark):
    left = spark.createDataFrame([(1, 5), (1, None), (None, 5), (1, 5)], "k int, t int")
    right = spark.createDataFrame([(1, None, "n"), (1, 6, "late"), (None, 1, "z")], "k int, rt int, v string")
    for most in (1, 1000):
        assert found(asof_join(left, right, ["k"], "t", "rt", ["v"], most)) == found(spark.createDataFrame([(1, 5, None), (1, None, None), (None, 5, None), (1, 5, None)], "k int, t int, v string"))


def test_asof_sessions_and_fill_in_blocks(spark, rows):
    left = rows.select("k", F.col("t"), "id").where("t is not null")
    right = rows.where("id % 3 = 0 and t is not null").select("k", F.col("t").alias("rt"), F.col("id").alias("v"))
    want = left.alias("l").join(right.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("rt") <= F.col("t")), "left").groupBy("l.k", "t", "id").agg(F.max(F.struct("rt", "v")).alias("m"))
    for most in (MANY, 10_000):
        assert found(asof_join(left, right, ["k"], "t", "rt", ["v"], most)) == found(want.select("k", "t", "id", "m.v"))
    events = table(spark, DATA, "events").withColumn("user_id", F.when(F.col("event_id") % 10 == 0, F.col("user_id")).otherwise(-1))
    assert found(sessions(events, "user_id", "ts", 1800, 50)) == found(sessions(events, "user_id", "ts", 1800))
    unique = rows.where("t is not null").withColumn("t", F.col("t") * 5000 + F.col("id"))
    upto = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    assert found(forward_fill(unique, ["k"], "t", "v", MANY)) == found(unique.withColumn("v", F.last("v", True).over(upto)))


def test_global_ranks_equal_one_window(spark, rows):
    w = Window.orderBy("t", "v")
    whole = Window.orderBy("t", "v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"))
    got = global_ranks(rows, ["t", "v"], partitions=7)
    assert found(got.select("id", "rank", "dense_rank")) == found(want)
    assert sorted(r["row_number"] for r in got.collect()) == list(range(1, 2001)) and {r["total_rows"] for r in got.collect()} == {2000}
    summed = global_ranks(rows, ["t", "v", "id"], {"s": "v"}, 7).select("id", "row_number", "s")
    assert found(summed) == found(rows.select("id", F.row_number().over(Window.orderBy("t", "v", "id")).alias("row_number"), F.sum(F.coalesce("v", F.lit(0))).over(whole).alias("s")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Exchange" in plan
    assert global_ranks(rows.limit(0), ["t"], {"s": "v"}).collect() == []
