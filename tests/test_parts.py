"""Files, joins and streams."""

import pytest
from pyspark.sql import functions as F

from brindle.operators.joins import asof_join, salted_join
from brindle.operators.windows import forward_fill
from brindle.plans import catalogue
from brindle.session import table
from brindle.sources import files
from brindle.streaming import events as ev

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", sorted(files.FORMATS))
def test_round_trip(spark, tmp_path, fmt):
    df = table(spark, DATA, "events").limit(200)
    df = df.select("props") if fmt == "text" else df  # lines are all it holds
    files.write(df, str(tmp_path / fmt), fmt)
    back = files.read(spark, str(tmp_path / fmt), fmt, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_text_formats_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "csv")


def test_csv_keeps_blanks_and_tells_empty_texts_from_null(spark, tmp_path):
    texts = ["", None, " ", "  a", "a \t", "\n", "\na\r\n", "a\r", "\0a", "\x0b", ' "a" ', '"', "\\", "\\N", "\\\\N", "\\N\n", "a\\N", "a,b"]
    rows = [(i, t, texts[-i]) for i, t in enumerate(texts)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.QUERIES["scan_csv"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr)
    one = df.select("text").coalesce(1)  # a line of nothing but an empty or a null text stays a row
    files.write(one, str(tmp_path / "one"), "csv")
    assert [r["text"] for r in files.read(spark, str(tmp_path / "one"), "csv", one.schema).collect()] == [*texts, None]


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 3), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c"), (None, 1, "z")], "k int, rt int, v string")
    found = {(r["k"], r["t"]): r["v"] for r in asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert found == {(1, 5): "b", (1, 1): None, (2, 3): None, (None, 3): None}


def test_salted_join_equals_join(spark):
    large = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert sorted(salted_join(large, small, "k", 8).collect()) == sorted(large.join(small, "k").collect())


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    for name, df in (("left_b", spark.range(2000).select((F.col("id") % 97).alias("k"), "id")), ("right_b", spark.range(97).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))):
        files.write_bucketed(df, name, ["k"], 4)
    joined = spark.table("left_b").hint("merge").join(spark.table("right_b"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 2000
    for name in ("left_b", "right_b"):
        spark.sql(f"drop table {name}")


def test_filters_and_columns_reach_the_scan(spark):
    from brindle.plans import catalogue

    plan = catalogue.QUERIES["pricing_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_orderkey" not in plan[plan.index("ReadSchema") :]


def test_visible_text_of_hostile_pages(spark):
    from brindle.functions.text import visible_text

    pages = ["<p>a</p><script>" + "a<b;" * 250_000 + "</script><p>b", "<" * 100_000 + "p>x", "<style>" * 100_000, "<script" + " <!" * 100_000]
    got = [r["t"] for r in spark.createDataFrame([(p,) for p in pages], "html string").select(visible_text(F.col("html")).alias("t")).collect()]
    assert got == ["a b", "<" * 99_999 + " x", "", ""]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from brindle import session

    class Cluster:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_forward_fill(spark):
    df = spark.createDataFrame([(1, 1, 7), (1, 2, None), (1, 3, 8), (2, 1, None)], "g int, o int, v int")
    assert [r["v"] for r in forward_fill(df, ["g"], "o", "v").orderBy("g", "o").collect()] == [7, 7, 8, None]


def source(spark, tmp_path):
    df = table(spark, DATA, "events")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return ev.stream(spark, str(tmp_path / "in"), df.schema), df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_tumbling_stream_equals_batch(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    ev.to_table(ev.tumbling(stream), "tumbled", str(tmp_path / "c"), "complete").awaitTermination()
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    assert sorted(spark.table("tumbled").select("start", "event_type", "n").collect()) == sorted(want.collect())


def test_running_totals_equal_batch(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    totals = ev.running_totals(stream)
    ev.to_files(totals, str(tmp_path / "out"), str(tmp_path / "c"), "update").awaitTermination()
    got = {r["user_id"]: (r["n"], round(r["total"], 4)) for r in ev.latest(spark, str(tmp_path / "out"), totals.schema, ["user_id"]).collect()}
    assert got == {r["user_id"]: (r["n"], round(r["total"], 4)) for r in batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}


def test_update_mode_keeps_groups_absent_from_later_batches(spark, tmp_path):
    schema = table(spark, DATA, "events").schema
    for k in range(2):  # a second run meets other users only
        table(spark, DATA, "events").where(F.col("user_id") % 2 == k).write.mode("append").parquet(str(tmp_path / "in"))
        totals = ev.running_totals(ev.stream(spark, str(tmp_path / "in"), schema))
        ev.to_files(totals, str(tmp_path / "out"), str(tmp_path / "c"), "update").awaitTermination()
    got = ev.latest(spark, str(tmp_path / "out"), totals.schema, ["user_id"])
    assert got.count() == got.select("user_id").distinct().count() == table(spark, DATA, "events").select("user_id").distinct().count()
    assert got.agg(F.sum("n")).first()[0] == table(spark, DATA, "events").count()


def test_bucketed_query_shuffles_nothing_after_its_tables(spark):
    from brindle.plans import formats

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = formats.scan_bucketed(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_once_each(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    ev.to_table(ev.once_each(stream), "once", str(tmp_path / "c")).awaitTermination()
    assert spark.table("once").count() == batch.count()
