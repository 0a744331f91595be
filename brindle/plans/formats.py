"""Each file format: a table written to the shared folder in that format and read back; SQL reads the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.catalogue import query
from brindle.session import new_path, table
from brindle.sources import files, keyed
from brindle.sources.snapshots import Snapshots
from brindle.streaming import events as ev


def _path(spark: SparkSession) -> str:
    return new_path(spark, "files")


def _through(df: DataFrame, fmt: str, partition_by: list[str] | None = None) -> DataFrame:
    at = _path(df.sparkSession)
    files.write(df, at, fmt, partition_by)
    return files.read(df.sparkSession, at, fmt, df.schema)


@query("select o_orderkey, o_orderdate, o_totalprice from orders where o_totalprice > 100000")
def scan_orc(spark, d):
    return _through(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "orc").where("o_totalprice > 100000")


@query("select event_id, ts, value, props from events where event_type = 'click'")
def scan_json(spark, d):
    return _through(table(spark, d, "events"), "json").where("event_type = 'click'").select("event_id", "ts", "value", "props")


@query("select doc_id, text, lang from documents")
def scan_csv(spark, d):
    """Whole texts, quotes and line ends included."""
    return _through(table(spark, d, "documents").select("doc_id", "text", "lang"), "csv")


@query("select s_suppkey, s_name, s_acctbal from supplier where s_acctbal < 5000")
def scan_xml(spark, d):
    return _through(table(spark, d, "supplier"), "xml").where("s_acctbal < 5000").select("s_suppkey", "s_name", "s_acctbal")


@query("select p_name as value, count(*) as n from part group by 1")
def scan_text(spark, d):
    return _through(table(spark, d, "part").select(F.col("p_name").alias("value")), "text").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n_lines, cast(sum(length(p_name)) + count(*) as bigint) as n_bytes from part")
def scan_binary_files(spark, d):
    """Lines and bytes of files read whole; each file is a row, so files stay as small as the writer's partitions."""
    at = _path(spark)
    files.write(table(spark, d, "part").select(F.col("p_name").alias("value")), at, "text")
    found = files.read_binary(spark, at, "*.txt")
    lines = F.size(F.split(F.col("content").cast("string"), "\n")).cast("long") - 1
    return found.agg(F.sum(lines).alias("n_lines"), F.sum("length").alias("n_bytes"))


@query("select event_type, count(*) as n, max(event_id) as last from events where event_type in ('click', 'purchase') group by 1")
def scan_partitioned(spark, d):
    """Folders by event_type; those of other types are not opened."""
    some = _through(table(spark, d, "events").select("event_id", "event_type"), "parquet", ["event_type"]).where(F.col("event_type").isin("click", "purchase"))
    return some.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("select o_orderkey, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1")
def scan_bucketed(spark, d):
    """Two tables bucketed alike, so that their join and the count after it need no shuffle."""
    names = [f"brindle_{uuid.uuid4().hex}" for _ in range(2)]
    for name, df, key in zip(names, (table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey")), ("o_orderkey", "l_orderkey")):
        files.write_bucketed(df, name, [key], 8, _path(spark))
    joined = spark.table(names[0]).join(spark.table(names[1]), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with kept as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders), changed as (
    select o_orderkey, o_custkey, o_orderstatus, case when o_custkey % 5 = 0 then round(o_totalprice * 2, 2) else o_totalprice end as o_totalprice from kept
    where not (o_orderstatus = 'P' and o_custkey % 5 = 1) union all select -1 - c_custkey, c_custkey, 'N', c_acctbal from customer)
    select 0 as version, * from kept union all select 1, * from changed"""
)
def snapshot_versions(spark, d):
    """Orders in two versions: some dearer, some gone, one new for each customer; both are read from the table."""
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders = table(spark, d, "orders").select(*names)
    made = Snapshots.create(orders, new_path(spark, "snapshots"), ["o_orderkey"], 16)
    dearer = orders.where("o_custkey % 5 = 0").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"), F.lit(False).alias("gone"))
    gone = orders.where("o_orderstatus = 'P' and o_custkey % 5 = 1").select(*names, F.lit(True).alias("gone"))
    new = table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"), F.lit(False).alias("gone"))
    made.upsert(dearer.unionByName(gone).unionByName(new), "gone")
    return made.read(0).select(F.lit(0).alias("version"), *names).unionAll(made.read(1).select(F.lit(1).alias("version"), *names))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey >= 1000 and o_orderkey < 1200 and o_totalprice > 1000")
def scan_own_format(spark, d):
    """A range of keys from a data source of our own: files out of the range are not opened."""
    at = new_path(spark, "keyed")
    keyed.register(spark)
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartitionByRange(8, "o_orderkey").write.format(keyed.NAME).option("key", "o_orderkey").mode("append").save(at)
    return keyed.load(spark, at, "o_orderkey", 1000, 1199).where("o_totalprice > 1000")


@query("select event_type, count(*) as n, max(event_id) as last from events group by 1")
def stream_own_format(spark, d):
    """The same source as a stream of two commits."""
    at, e = new_path(spark, "keyed"), table(spark, d, "events").select("event_id", "event_type")
    keyed.register(spark)
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.format(keyed.NAME).option("key", "event_id").mode("append").save(f"{at}/in")
    rows = spark.readStream.format(keyed.NAME).option("key", "event_id").load(f"{at}/in")
    ev.to_files(rows, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
