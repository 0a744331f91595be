"""Sessions, top rows of groups and gap filling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.scan import MOST, Blocks


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps only n rows of a group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def sessions(df: DataFrame, user: str, time: str, gap_seconds: int, most: int = MOST) -> DataFrame:
    """One row for each session: events of a user no further apart than the gap. Users of more than ``most`` events go in blocks."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    stream = df.select(user, time, at.alias("__us"), F.monotonically_increasing_id().alias("__id"))
    blocks = Blocks.of(stream, [user], ["__us", "__id"], most).scan(previous={"__before": "__us"})
    new = F.coalesce((F.col("__us") - F.col("__before") > gap_seconds * 1_000_000).cast("long"), F.lit(1).cast("long"))
    marked = replace(blocks, rows=blocks.rows.withColumn("__new", new)).scan(sums={"session": "__new"}).done()
    return marked.groupBy(user, "session").agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("started"), F.max(time).alias("ended"))


def forward_fill(df: DataFrame, group: list[str], order: str, column: str, most: int = MOST) -> DataFrame:
    """Null values take the last one before them in their group. Groups of more than ``most`` rows go in blocks."""
    stream = df.withColumn("__id", F.monotonically_increasing_id())
    filled = Blocks.of(stream, group, [order, "__id"], most).scan(last={"__filled": column}).done()
    return filled.withColumn(column, F.col("__filled")).drop("__filled", "__id")
