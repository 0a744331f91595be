"""As-of and range joins as plans that stay linear in their inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.scan import MOST, Blocks
from brindle.session import keep


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, right_time: str, values: list[str], most: int = MOST) -> DataFrame:
    """For each left row, ``values`` of the last right row of the same key at or before its time.

    What is found depends on key and time alone, so it is looked for once for each key and time that the left side has:
    these and the right side's are put in one stream and the last right row is carried forward, where an inequality join
    would compare all pairs of a key. A key of more than ``most`` times goes in blocks (see scan.Blocks), so that no task
    holds it whole. A join by key and time then gives it to the left rows, without a shuffle of them where times are few.
    Right rows with equal key and time: the largest values win. Left rows with a null key or time match nothing and are
    not shuffled; nor does a right row with one.
    """
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), [*on, time], F.lit(True))
    there = reduce(lambda a, k: a & F.col(k).isNotNull(), [*on, right_time], F.lit(True))
    one = right.where(there).groupBy(*on, F.col(right_time).alias("__t")).agg(F.max(F.struct(*values)).alias("__v"))
    asked = left.where(known).select(*on, F.col(time).alias("__t")).distinct()
    stream = asked.select(*on, "__t", F.lit(1).alias("__side"), F.lit(None).cast(one.schema["__v"].dataType).alias("__v"))
    both = keep(stream.unionAll(one.select(*on, "__t", F.lit(0).alias("__side"), "__v")))
    carried = Blocks.of(both, on, ["__t", "__side"], most).scan(last={"__r": "__v"}).done().where("__side = 1")
    found = keep(carried.select(*[F.col(k).alias(f"__k_{k}") for k in on], "__t", "__r"))
    met = left.where(known).join(found, reduce(lambda a, k: a & (left[k] == found[f"__k_{k}"]), on, left[time] == found["__t"]), "left")
    alone = left.where(~known).select(*left.columns, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return met.select(*left.columns, *[F.col(f"__r.{v}").alias(v) for v in values]).unionAll(alone)


def range_join(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs with low <= at < high: ranges are put in every bin of ``width`` they touch, points in theirs, then equal bins join."""
    bins = F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    left = points.withColumn("__bin", F.floor(at / width))
    right = ranges.withColumn("__bin2", bins)
    return left.join(right, F.col("__bin") == F.col("__bin2")).where((at >= low) & (at < high)).drop("__bin", "__bin2")


def salted_join(large: DataFrame, small: DataFrame, on: str, salts: int) -> DataFrame:
    """Inner join whose hot keys on the large side are dealt over ``salts`` tasks, equal rows too; the small side is repeated as often."""
    left = large.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "__salt"]).drop("__salt")
