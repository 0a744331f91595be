"""Aggregates, windows, joins and sets beyond the first catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions.numbers import histogram_bin
from brindle.operators.joins import salted_join
from brindle.operators.quantiles import quantiles
from brindle.operators.windows import forward_fill
from brindle.plans.catalogue import both, query
from brindle.session import table


@query(
    """select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) as bigint) as level from orders
    group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"""
)
def grouping_sets(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[s, p], [p], []], s, p).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(s, p).alias("level")).select("o_orderstatus", "o_orderpriority", "n", "level")


@query(
    """select l_suppkey, l_linenumber as common from (select *, row_number() over (partition by l_suppkey order by n desc, l_linenumber) as rn
    from (select l_suppkey, l_linenumber, count(*) as n from lineitem group by all)) where rn = 1"""
)
def mode_per_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.mode("l_linenumber", True).alias("common"))


@query(
    """select o_custkey, round(quantile_cont(o_totalprice, 0.25), 6) as low, round(quantile_cont(o_totalprice, 0.9), 6) as high,
    quantile_disc(o_totalprice, 0.5) as middle from orders group by 1"""
)
def percentiles(spark, d):
    found = quantiles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", {"low": (0.25, "cont"), "high": (0.9, "cont"), "middle": (0.5, "disc")})
    return found.select("o_custkey", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "middle")


@query(
    """with m as (select l_returnflag, avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem group by 1)
    select l_returnflag, round(avg(power((l_quantity - m) / s, 3)), 6) as skew, round(avg(power((l_quantity - m) / s, 4)) - 3, 6) as kurt from lineitem join m using (l_returnflag) group by 1"""
)
def shape_of_distribution(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.skewness("l_quantity"), 6).alias("skew"), F.round(F.kurtosis("l_quantity"), 6).alias("kurt"))


@query(
    """select l_returnflag, round(covar_pop(l_extendedprice, l_quantity), 4) as cov, round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
    round(regr_intercept(l_extendedprice, l_quantity), 3) as base, round(regr_r2(l_extendedprice, l_quantity), 6) as fit from lineitem group by 1"""
)
def regression(spark, d):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.covar_pop(y, x), 4).alias("cov"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("base"), F.round(F.regr_r2(y, x), 6).alias("fit")
    )


@query(
    """select o_custkey, arg_max(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) as dearest, arg_min(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) as cheapest,
    any_value(o_custkey) as some, bool_or(o_orderstatus = 'P') as has_p, bool_and(o_totalprice > 1000) as all_high from orders group by 1"""
)
def extremes(spark, d):
    at = F.struct("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", at).alias("dearest"), F.min_by("o_orderkey", at).alias("cheapest"), F.any_value("o_custkey").alias("some"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("has_p"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_high"),
    )


@query("select user_id, bit_and(event_id) as all_bits, bit_or(event_id) as any_bits, bit_xor(event_id) as odd_bits from events group by 1")
def bit_aggregates(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bit_and("event_id").alias("all_bits"), F.bit_or("event_id").alias("any_bits"), F.bit_xor("event_id").alias("odd_bits"))


@query("select p_brand, string_agg(distinct p_type, '|' order by p_type) as kinds, count(distinct p_size) as sizes from part group by 1")
def distinct_strings(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("kinds"), F.count_distinct("p_size").alias("sizes"))


@query("select l_returnflag, count(distinct l_partkey) as n, true as near from lineitem group by 1")
def approximate_distinct(spark, d):
    """The exact number, and whether HyperLogLog and its mergeable sketch are each within 10 % of it."""
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey"))
    some = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("a"), sketch.alias("b"))
    return some.select("l_returnflag", "n", ((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")) & (F.abs(F.col("b") - F.col("n")) <= 0.1 * F.col("n"))).alias("near"))


@query(
    """select case when c_acctbal < 0 then 0 when c_acctbal >= 5000 then 11 else cast(floor(c_acctbal / 5000 * 10) as bigint) + 1 end as bin, count(*) as n from customer group by 1"""
)
def histogram(spark, d):
    return table(spark, d, "customer").groupBy(histogram_bin(F.col("c_acctbal"), 0.0, 5000.0, 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select event_id, round(percent_rank() over w, 9) as pr, round(cume_dist() over w, 9) as cd, nth_value(value, 2) over f as second, last_value(value) over f as newest
    from events window w as (partition by user_id order by value, event_id), f as (partition by user_id order by ts rows between unbounded preceding and unbounded following)"""
)
def distribution_ranks(spark, d):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    f = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select(
        "event_id", F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.nth_value("value", 2).over(f).alias("second"), F.last("value").over(f).alias("newest")
    )


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as in_6h from events")
def time_range_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3_600_000_000, 0)
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("in_6h"))


@query("select event_id, last_value(case when event_id % 3 = 0 then value end ignore nulls) over (partition by user_id order by ts) as filled from events")
def filled_forward(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("filled"))
    return forward_fill(rows, ["user_id"], "ts", "filled").select("event_id", "filled")


@query(
    """select date_trunc('hour', ts) - to_hours(k) as start, count(*) as n from events, (values (0), (1)) t(k) group by all"""
)
def sliding_windows(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """with m as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 7200000000 then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts) as session from m)
    select user_id, min(ts) as start, max(ts) + interval 2 hours as "end", count(*) as n from s group by user_id, session"""
)
def session_windows(spark, d):
    w = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def salted_join_orders(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return salted_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), people, "o_custkey", 4).select("o_orderkey", "c_mktsegment")


@query(
    """select n_name, s_suppkey, s_acctbal from nation, lateral (select s_suppkey, s_acctbal from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 2)"""
)
def lateral_top(spark, d):
    inner = table(spark, d, "supplier").where(F.col("s_nationkey") == F.col("n_nationkey").outer()).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(2)
    return table(spark, d, "nation").lateralJoin(inner).select("n_name", "s_suppkey", "s_acctbal")


@query("select p_partkey, 'p_size' as name, cast(p_size as double) as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part")
def unpivot_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_flags(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10 offset 25")
def page_of_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(25).limit(10)


@query("select a.l_orderkey as k, count(*) as n from lineitem a join lineitem b on a.l_partkey is not distinct from b.l_partkey and a.l_suppkey = b.l_suppkey and a.l_shipdate < b.l_shipdate group by 1")
def null_safe_self_join(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    b = a.toDF("k2", "p2", "s2", "t2")
    return a.join(b, F.col("l_partkey").eqNullSafe(F.col("p2")) & (F.col("l_suppkey") == F.col("s2")) & (F.col("l_shipdate") < F.col("t2"))).groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))


both("set_union_all", "select c_nationkey as k from customer union all select s_nationkey from supplier", "customer", "supplier")
both("set_intersect_all", "select c_nationkey as k from customer intersect all select s_nationkey from supplier", "customer", "supplier")
both("set_except", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 2000", "nation", "supplier")
both("in_subquery", "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1)", "supplier", "nation")
both("common_table", "with big as (select o_custkey as k, count(*) as n from orders group by o_custkey) select a.k, a.n from big a join (select max(n) as top from big) m on a.n = m.top", "orders")
both("union_of_groups", "select 'c' as side, c_nationkey as k, count(*) as n from customer group by c_nationkey union all select 's', s_nationkey, count(*) from supplier group by s_nationkey", "customer", "supplier")
