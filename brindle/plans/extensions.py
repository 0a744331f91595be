"""User-defined functions of every kind, in Arrow batches; each does what an expression could, so that SQL can check it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from brindle.functions import tables
from brindle.operators.sketches import rolled_up, set_estimates, sketches
from brindle.plans.catalogue import query
from brindle.session import table


@query("select o_orderkey, round(o_totalprice * 1.1, 2) > 100000 as high from orders")
def scalar_pandas_function(spark, d):
    @F.pandas_udf("boolean")
    def high(price: pd.Series) -> pd.Series:
        return (price * 1.1).round(2) > 100000

    return table(spark, d, "orders").select("o_orderkey", high("o_totalprice").alias("high"))


@query("select l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as mean from lineitem group by 1")
def weighted_mean_partials(spark, d):
    """A mean as partial sums of each Arrow batch, merged by Spark, so that no group is in one task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table({"g": b.column(0), "x": pc.multiply(b.column(1), b.column(2)), "w": b.column(1)}).group_by("g").aggregate([("x", "sum"), ("w", "sum")])
            yield from t.select(["g", "x_sum", "w_sum"]).rename_columns(["l_returnflag", "x", "w"]).to_batches()

    parts = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice").mapInArrow(partial, "l_returnflag string, x double, w double")
    return parts.groupBy("l_returnflag").agg(F.round(F.sum("x") / F.sum("w"), 4).alias("mean"))


@query("select o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) as spread from orders group by 1")
def aggregate_pandas_function(spark, d):
    @F.pandas_udf("double")
    def spread(price: pd.Series) -> float:
        return round(float(price.max() - price.min()), 2)

    return table(spark, d, "orders").groupBy("o_custkey").agg(spread("o_totalprice").alias("spread"))


@query("select o_orderkey, round(o_totalprice - avg(o_totalprice) over (partition by o_custkey), 2) + 0.0 > 0 as above from orders")
def grouped_frames(spark, d):
    def centred(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderkey": part["o_orderkey"], "above": (part["o_totalprice"] - part["o_totalprice"].mean()).round(2) > 0})

    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").groupBy("o_custkey").applyInPandas(centred, "o_orderkey long, above boolean")


@query("select cast(n_nationkey as bigint) as k, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation where n_nationkey in (select c_nationkey from customer union select s_nationkey from supplier)")
def cogrouped_frames(spark, d):
    def count(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(left)], "suppliers": [len(right)]})

    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).groupBy("k")
    return left.cogroup(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).groupBy("k")).applyInPandas(count, "k long, customers long, suppliers long")


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def table_function(spark, d):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in (text or "").split(" "):
                yield (w,)

    words = Words(F.col("p_name").outer())
    return table(spark, d, "part").lateralJoin(words).select("p_partkey", "word")


@query("select c_custkey, c_acctbal from customer where c_acctbal > 5000")
def mapped_frames(spark, d):
    def rich(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[part["c_acctbal"] > 5000]

    return table(spark, d, "customer").select("c_custkey", "c_acctbal").mapInPandas(rich, "c_custkey long, c_acctbal double")


@query(
    """with marked as (select user_id, ts, value, case when value > lag(value) over (partition by user_id order by ts) then 0 else 1 end as fresh from events),
    runs as (select *, sum(fresh) over (partition by user_id order by ts) as r from marked),
    long as (select user_id, r, count(*) as length, min(value) as low, max(value) as high from runs group by user_id, r having count(*) >= 3)
    select user_id, row_number() over (partition by user_id order by r) as run, length, low, high from long"""
)
def rising_runs(spark, d):
    """Runs of three or more rising values of each user, by a function of a whole table that says itself how its rows are dealt."""
    tables.register(spark)
    table(spark, d, "events").select("user_id", "ts", "value").createOrReplaceTempView("events_of_users")
    return spark.sql("select user_id, run, length, low, high from rises(table(events_of_users), 'user_id', 'ts', 'value', 3)")


@query(
    """with users as (select distinct event_type, user_id * 1000 + dayofyear(ts) as k from events),
    counted as (select event_type, count(*) as n from users group by 1),
    shared as (select a.event_type as a, b.event_type as b, count(*) as n from users a join users b on a.k = b.k and a.event_type < b.event_type group by all)
    select x.event_type as a, y.event_type as b, x.n as in_a, x.n + y.n - coalesce(s.n, 0) as in_either, coalesce(s.n, 0) as in_both, x.n - coalesce(s.n, 0) as only_a, true as near
    from counted x join counted y on x.event_type < y.event_type left join shared s on s.a = x.event_type and s.b = y.event_type"""
)
def sketched_sets(spark, d):
    """Users by day that two types of events share: exact counts, and whether the sketches, kept by day and rolled up, are all within 6 % of the union."""
    day = F.date_trunc("day", "ts")
    e = table(spark, d, "events").select("event_type", day.alias("day"), (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("k"))
    guess = set_estimates(rolled_up(sketches(e, ["event_type", "day"], "k"), ["event_type"]), "event_type")
    users = e.select("event_type", "k").distinct()
    kinds = users.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    both = users.toDF("a", "k").join(users.toDF("b", "k"), "k").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("in_both"))
    pairs = kinds.toDF("a", "in_a").join(kinds.toDF("b", "in_b"), F.col("a") < F.col("b")).join(both, ["a", "b"], "left").withColumn("in_both", F.coalesce("in_both", F.lit(0)))
    exact = pairs.select("a", "b", "in_a", (F.col("in_a") + F.col("in_b") - F.col("in_both")).alias("in_either"), "in_both", (F.col("in_a") - F.col("in_both")).alias("only_a"))
    names = ("in_a", "in_either", "in_both", "only_a")
    told = exact.join(guess.withColumnsRenamed({n: f"guess_{n}" for n in names}), ["a", "b"])
    near = F.greatest(*[F.abs(F.col(n) - F.col(f"guess_{n}")) for n in names]) <= 0.06 * F.col("in_either")
    return told.select("a", "b", *names, near.alias("near"))
