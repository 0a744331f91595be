"""The event table read as a stream; what the stream wrote when it had read all is compared with SQL over the table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.catalogue import query
from brindle.session import new_path, table
from brindle.sources.snapshots import Snapshots
from brindle.streaming import events as ev
from brindle.streaming import state


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ev.stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)


def _written(df: DataFrame, mode: str) -> DataFrame:
    """Run over all that is there, into files of the shared folder, and read them."""
    spark = df.sparkSession
    at = new_path(spark, "stream")
    ev.to_files(df, f"{at}/out", f"{at}/checkpoint", mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def stream_tumbling(spark, d):
    return _written(ev.tumbling(_events(spark, d)).select("start", "event_type", "n"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select date_trunc('hour', ts) - to_hours(k) as start, count(*) as n from events, (values (0), (1), (2)) t(k) group by all")
def stream_sliding(spark, d):
    return _written(ev.sliding(_events(spark, d), "3 hours", "1 hour"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select event_id, user_id from events")
def stream_once_each(spark, d):
    twice = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _written(ev.once_each(twice).select("event_id", "user_id"), "append")


@query("select e.event_id, c.c_mktsegment from events e join customer c on e.user_id = c.c_custkey")
def stream_static_join(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return _written(_events(spark, d).join(people, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"), "append")


@query(
    """select a.event_id as click, b.event_id as purchase from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour
    where a.event_type = 'click' and b.event_type = 'purchase'"""
)
def stream_interval_join(spark, d):
    return _written(ev.followed_by(_events(spark, d), "click", "purchase", "1 hour"), "append")


@query(
    """with marked as (select user_id, ts, case when ts <= lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 0 else 1 end as new from events),
    numbered as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from marked)
    select min(ts) as start, user_id, count(*) as n from numbered group by user_id, k"""
)
def stream_session_windows(spark, d):
    return _written(ev.session_counts(_events(spark, d)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _parts(spark: SparkSession, d: str, at: str, parts: int, held: Column | None = None) -> Iterator[int]:
    """The event table put into a folder in so many parts by time, one before each step of the caller; rows ``held`` come a part later.

    Parts are of equal spans of time, so that a stream over the folder has run up to a known time after each.
    """
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = e.agg(F.min(us), F.max(us)).first()
    part = F.least(F.lit(parts - 1), F.floor((us - low) / F.lit(max(1, -(-(high - low + 1) // parts))))).cast("int")
    late = part if held is None else F.least(F.lit(parts - 1), part + held.cast("int"))
    for k in range(parts):
        e.where(late == k).write.mode("append").parquet(f"{at}/in")
        yield k


#: Parts of the event table that the queries below go over, one run each, the state of one read by the next.
PARTS = 3


@query("select user_id, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_running_totals(spark, d):
    """State of each user over several batches; each replaces the totals of its users in a snapshot table."""
    at, schema = new_path(spark, "stream"), table(spark, d, "events").schema
    Snapshots.create(spark.createDataFrame([], "user_id long, n long, total double"), f"{at}/out", ["user_id"], 4)
    for _ in _parts(spark, d, at, PARTS):
        state.run_on(ev.running_totals(ev.stream(spark, f"{at}/in", schema)), f"{at}/out", f"{at}/checkpoint", "update")
    return Snapshots(spark, f"{at}/out").read().withColumn("total", F.round("total", 2))


@query(
    """with marked as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 21600000000 then 0 else 1 end as new from events),
    numbered as (select user_id, ts, cast(sum(new) over (partition by user_id order by ts rows unbounded preceding) as bigint) as spell from marked)
    select user_id, spell, min(ts) as started, max(ts) as ended, count(*) as n from numbered group by user_id, spell
    having epoch_ms(max(ts)) + 21600000 < (select epoch_ms(max(ts)) from events) or spell < (select max(spell) from numbered m where m.user_id = numbered.user_id)"""
)
def stream_inactive_users(spark, d):
    """Spells of users that six hours without an event have ended, by timers, over several runs."""
    at, schema = new_path(spark, "stream"), table(spark, d, "events").schema
    for _ in _parts(spark, d, at, PARTS):
        state.run_on(state.spells(ev.stream(spark, f"{at}/in", schema), 6 * 3600), f"{at}/out", f"{at}/checkpoint")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.schema("user_id long, spell long, started timestamp, ended timestamp, n long").parquet(f"{at}/out").select("user_id", "spell", ntz("started"), ntz("ended"), "n")


@query(
    """with mark as (select least((select max(ts) from events where event_type = 'click'), (select max(ts) from events where event_type = 'purchase')) as wm),
    pairs as (select a.event_id as click, b.event_id as purchase from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 3 hours
    where a.event_type = 'click' and b.event_type = 'purchase')
    select * from pairs union all
    select event_id, null from events, mark where event_type = 'click' and event_id not in (select click from pairs) and epoch_ms(ts) + 10800000 < epoch_ms(wm)"""
)
def stream_outer_join(spark, d):
    """Clicks with the purchases within three hours, and those with none once the watermark says that none can come."""
    at, schema = new_path(spark, "stream"), table(spark, d, "events").schema
    for _ in _parts(spark, d, at, PARTS):
        state.run_on(state.followed_or_not(ev.stream(spark, f"{at}/in", schema), "click", "purchase", "3 hours"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("click long, purchase long").parquet(f"{at}/out")


@query(
    """with bounds as (select epoch_us(min(ts)) as low, epoch_us(max(ts)) as high from events),
    placed as (select *, date_trunc('hour', ts) as start, least(2, (epoch_us(ts) - low) // greatest(1, (high - low + 3) // 3)) as part from events, bounds),
    come as (select *, least(2, part + case when event_id % 5 = 0 then 1 else 0 end) as run from placed),
    marks as (select run, max(max(ts)) over (order by run rows between unbounded preceding and 1 preceding) - interval 1 hour as wm from come group by run),
    judged as (select start, event_type, wm is not null and start + interval 1 hour <= date_trunc('milliseconds', wm) as dropped from come join marks using (run))
    select start, event_type, count(*) filter (where not dropped) as n, count(*) filter (where dropped) as late from judged
    where start + interval 1 hour <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events) group by all having count(*) filter (where not dropped) > 0"""
)
def stream_late_rows(spark, d):
    """A fifth of the events comes a part too late: hours that have been closed leave them out, and each says how many."""
    at, e = new_path(spark, "stream"), table(spark, d, "events")
    for _ in _parts(spark, d, at, PARTS, F.col("event_id") % 5 == 0):
        state.run_on(ev.tumbling(ev.stream(spark, f"{at}/in", e.schema)).select("start", "event_type", "n"), f"{at}/out", f"{at}/checkpoint")
    closed = spark.read.schema("start timestamp, event_type string, n long").parquet(f"{at}/out")
    every = e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("all"))
    return closed.join(every, ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.col("all") - F.col("n")).alias("late"))
