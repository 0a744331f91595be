"""Queries over the relational and event tables, each with SQL that another engine can run on the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.arrays import dot
from brindle.functions.numbers import cents
from brindle.operators.joins import asof_join, range_join
from brindle.operators.quantiles import quantiles
from brindle.operators.vectors import cosine_search
from brindle.operators.windows import sessions, top_per_group
from brindle.session import table, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function (spark, sf_dir) under its name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str, *tables: str) -> None:
    """Register SQL text that Spark and the other engine read alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


MONEY = "cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2)))"


@query(
    f"""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty,
    cast(sum({MONEY}) as double) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""
)
def pricing_summary(spark, d):
    money = cents(F.col("l_extendedprice")) * (1 - cents(F.col("l_discount")))
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(cents(F.col("l_quantity"))).cast("double").alias("sum_qty"), F.sum(money).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n")
    )


@query("select l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem where l_quantity > 45 and l_discount between 0.05 and 0.07")
def filter_project(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity > 45 and l_discount between 0.05 and 0.07")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def inner_join(spark, d):
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("select o_orderkey, l_partkey from orders left join lineitem on o_orderkey = l_orderkey")
def left_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey")


@query("select c_custkey, s_suppkey from customer full join supplier on c_custkey = s_suppkey * 20")
def full_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey") * 20, "full").select("c_custkey", "s_suppkey")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 40)")
def semi_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal")
def theta_join(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a, b = s.toDF("a", "nation", "low"), s.toDF("b", "nation", "high")
    return a.join(b, "nation").where("low < high").select("a", "b")


@query(
    """select e.event_id, arg_max(f.value, f.ts) as last_purchase from (select * from events where event_type = 'click') e
    left join (select * from events where event_type = 'purchase') f on e.user_id = f.user_id and f.ts <= e.ts group by e.event_id"""
)
def asof_last_purchase(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_purchase"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof_join(clicks, bought, ["user_id"], "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@query("select p_partkey, s_suppkey from part join supplier on p_retailprice >= s_acctbal and p_retailprice < s_acctbal + 5")
def range_join_prices(spark, d):
    found = range_join(table(spark, d, "part"), table(spark, d, "supplier"), F.col("p_retailprice"), F.col("s_acctbal"), F.col("s_acctbal") + 5, 50.0)
    return found.select("p_partkey", "s_suppkey")


@query(
    """select n_name, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from region join nation on n_regionkey = r_regionkey
    join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where r_name = 'ASIA' group by n_name"""
)
def star_join(spark, d):
    place = table(spark, d, "region").where("r_name = 'ASIA'").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    people = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    sold = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return sold.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("o_totalprice"))).cast("double").alias("total"))


@query(
    """select l_suppkey, count(distinct l_partkey) as parts, min(l_quantity) as low, max(l_quantity) as high, median(l_quantity) as middle,
    count(*) filter (where l_returnflag = 'R') as returned from lineitem group by l_suppkey"""
)
def aggregates(spark, d):
    items = table(spark, d, "lineitem")
    middle = quantiles(items, ["l_suppkey"], "l_quantity", {"middle": (0.5, "cont")})
    found = items.groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("parts"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )
    return found.join(middle, "l_suppkey").select("l_suppkey", "parts", "low", "high", "middle", "returned")


@query("select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as vp, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1")
def statistics(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.var_pop(q), 6).alias("vp"), F.round(F.corr(q, p), 6).alias("r"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus) as g from orders group by rollup (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("long").alias("g"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube_orders(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select c_mktsegment, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'P') as P
    from orders join customer on o_custkey = c_custkey group by 1"""
)
def pivot_status(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
def ordered_strings(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query(
    """select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as quarter
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"""
)
def ranks(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    named = (("rn", F.row_number()), ("rk", F.rank()), ("dr", F.dense_rank()), ("quarter", F.ntile(4)))
    return table(spark, d, "orders").select("o_orderkey", *[f.over(w).cast("long").alias(n) for n, f in named])


@query(
    """select event_id, lag(value) over w as before, lead(value, 2) over w as after, first_value(value) over w as first_one,
    max(value) over (partition by user_id order by ts rows between 2 preceding and current row) as high3 from events window w as (partition by user_id order by ts)"""
)
def frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, d, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("value").over(w).alias("first_one"), F.max("value").over(w.rowsBetween(-2, 0)).alias("high3")
    )


@query("select o_custkey, o_orderkey, rn from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3")
def top3_orders(spark, d):
    found = top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return found.select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top20_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    """with m as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 3600000000 then 0 else 1 end as fresh from events),
    s as (select *, cast(sum(fresh) over (partition by user_id order by ts) as bigint) as session from m)
    select user_id, session, count(*) as n_events, min(ts) as started, max(ts) as ended from s group by user_id, session"""
)
def event_sessions(spark, d):
    return sessions(table(spark, d, "events"), "user_id", "ts", 3600)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def tumbling_windows(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


both("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier", "customer", "supplier")
both("set_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier", "customer", "supplier")
both("set_except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier", "customer", "supplier")
both("scalar_subquery", "select o_orderkey from orders o where o_totalprice > (select 1.5 * avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)", "orders")
both("not_in_subquery", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)", "customer", "orders")
both("recursive_series", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select n, count(r_regionkey) as c from t left join region on r_regionkey = n % 7 group by n", "region")
both("case_when", "select o_orderpriority, sum(case when o_totalprice > 150000 then 1 else 0 end) * 1.0 / count(*) > 0.5 as mostly_high, count(*) as n from orders group by o_orderpriority", "orders")
both("having_orders", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", "orders")


@query(
    """select c_custkey, upper(c_name) as up, substring(c_name, 3, 5) as part, length(c_name) as n, replace(c_name, '#', '-') as swapped,
    lpad(cast(c_nationkey as varchar), 4, '0') as padded, regexp_replace(c_name, '[0-9]+', 'N', 'g') as masked, md5(c_name) as digest from customer"""
)
def strings(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(c).alias("up"), F.substring(c, 3, 5).alias("part"), F.length(c).cast("long").alias("n"), F.replace(c, F.lit("#"), F.lit("-")).alias("swapped"),
        F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"), F.regexp_replace(c, "[0-9]+", "N").alias("masked"), F.md5(c).alias("digest"),
    )


@query(
    """select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, dayofweek(o_orderdate) + 1 as dow, date_trunc('month', o_orderdate)::timestamp as month_start,
    date_diff('day', timestamp '1992-01-01', o_orderdate) as days from orders"""
)
def dates(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year(at).cast("long").alias("y"), F.quarter(at).cast("long").alias("q"), F.dayofweek(at).cast("long").alias("dow"),
        F.date_trunc("month", at).cast("timestamp_ntz").alias("month_start"), F.datediff(at, F.lit("1992-01-01").cast("date")).cast("long").alias("days"),
    )


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as square, round(embedding[1]::double, 6) as first_one, len(list_filter(embedding, lambda x: x > 0)) as positive from embeddings")
def arrays(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(dot(e, e), 6).alias("square"), F.round(e[0].cast("double"), 6).alias("first_one"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive")
    )


@query(
    """select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cos from embeddings a, embeddings b
    where a.vec_id % 20 = 0 and b.vec_id <> a.vec_id and round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) > 0.3"""
)
def similar_vectors(spark, d):
    """The queries, every twentieth id, against all rows of any label."""
    v = table(spark, d, "embeddings")
    return cosine_search(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 0.3)


@query("select conv_id, role, count(*) as n, max(length(text)) as longest from conversations group by all")
def conversation_turns(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query("select lang, quality, toxic, count(*) as n, sum(n_chars)::bigint as chars from documents join labels using (doc_id) group by all")
def label_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# The tables hold no nulls: these make their own, of outer joins and nullif.
both("not_in_with_nulls", "select c_custkey from customer where c_custkey not in (select nullif(o_custkey, 4) from orders where o_totalprice > 100000)", "customer", "orders")
both("null_aggregates", "select o_orderpriority, count(*) as n, count(l_quantity) as known, sum(l_quantity) as total, max(l_quantity) as high, count(distinct l_linenumber) as lines from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 48 group by o_orderpriority", "orders", "lineitem")
both("null_groups", "select nullif(o_orderstatus, 'F') as status, nullif(o_orderpriority, '1-URGENT') as priority, count(*) as n from orders group by nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '1-URGENT')", "orders")
both("null_order", "select s_suppkey, nullif(s_nationkey, 3) as nation, row_number() over (order by nullif(s_nationkey, 3) desc nulls last, s_suppkey) * cast(1 as bigint) as place from supplier", "supplier")
both("null_comparisons", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on nullif(a.s_nationkey, 1) is not distinct from nullif(b.s_nationkey, 2) and a.s_suppkey < b.s_suppkey", "supplier")
both("null_sets", "select nullif(c_nationkey, 5) as k from customer intersect select nullif(s_nationkey, 5) from supplier", "customer", "supplier")
both("null_logic", "select o_orderkey, (nullif(o_orderstatus, 'F') = 'O' and o_totalprice > 100000) as both_hold, (nullif(o_orderstatus, 'F') = 'O' or o_totalprice > 100000) as one_holds, coalesce(nullif(o_orderstatus, 'F'), 'none') as told from orders", "orders")
