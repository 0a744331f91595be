"""Windowed counts, deduplication and running totals of an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Files of a folder as a stream; ts becomes a zoned timestamp, as watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def once_each(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def followed_by(events: DataFrame, first: str, then: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of a user's events, ``then`` at most ``within`` after ``first``; state older than that is dropped."""
    a = events.where(F.col("event_type") == first).select(F.col("event_id").alias(first), F.col("user_id").alias("__a"), F.col("ts").alias("__from")).withWatermark("__from", late)
    b = events.where(F.col("event_type") == then).select(F.col("event_id").alias(then), F.col("user_id").alias("__b"), F.col("ts").alias("__to")).withWatermark("__to", late)
    near = (F.col("__to") > F.col("__from")) & (F.col("__to") <= F.col("__from") + F.expr(f"interval {within}"))
    return a.join(b, (F.col("__a") == F.col("__b")) & near).select(first, then)


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after each batch, kept as state of the user."""

    def add(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    kind = "n long, total double"
    return events.groupBy("user_id").applyInPandasWithState(add, f"user_id long, {kind}", kind, "update", GroupStateTimeout.NoTimeout)


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there, into a memory table."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there, into Parquet: batches are added, in complete mode each replaces the last.

    In update mode each batch is a folder of its own, as groups that a batch did not change are not in it; see latest().
    """
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return out.format("parquet").start(path)
    if mode == "update":
        return out.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    return out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()


def latest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """What to_files wrote in update mode: of each key the row of the newest batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    newest = F.max_by(F.struct(*[F.col(c) for c in schema.names]), "batch")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(newest.alias("row")).select("row.*")
