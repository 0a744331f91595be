"""Running values over ordered rows whose keys may hold any share of them: blocks, one summary a block, carries."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from brindle.session import keep

#: Rows of one key that a task may hold; keys with more are cut into blocks.
MOST = 1_000_000


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null equal to null."""
    return reduce(lambda on, k: on & left[k].eqNullSafe(right[k]), keys, F.lit(True))


def hot_keys(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, rows) of the keys with more than so many rows: no more of them than all rows over ``most``."""
    return keep(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > most))


def parted(df: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of other keys, and rows of hot ones. Each is one pass without a shuffle where the hot keys are few."""
    named = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    on = reduce(lambda a, k: a & df[k].eqNullSafe(named[f"__hot_{k}"]), keys, F.lit(True))
    return df.join(named, on, "left_anti"), df.join(named, on, "left_semi")


@dataclass(frozen=True)
class Blocks:
    """Rows with ``__block``: -1 where a key's rows are all together, else the range of (keys, order) that the row is in."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    split: bool

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[str], most: int = MOST) -> Blocks:
        """Count the rows of each key; those of hot keys go by range into blocks of about ``most`` / 2 rows, written once.

        Where that would make more partitions than Spark shuffles into, and than tasks of MOST / 2 rows need, a partition
        is sorted and cut into blocks: neither tasks nor files are as many as small blocks are. Rows of equal key and
        order may then lie in two blocks, so ``order`` should end in a column that tells rows apart.
        """
        hot = hot_keys(df, keys, most)
        many = hot.agg(F.sum("__rows")).first()[0]
        if not many:
            return Blocks(df.withColumn("__block", F.lit(-1)), keys, order, False)
        cold, rest = parted(df, hot, keys)
        blocks, tasks = -(-2 * many // most), max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * many // MOST))
        ranged = rest.repartitionByRange(min(blocks, tasks), *keys, *order)
        if blocks <= tasks:
            ranged = ranged.withColumn("__block", F.spark_partition_id())
        else:  # the number of the block's first row: partition in the upper bits, place there in the lower 33
            row = F.monotonically_increasing_id()
            ranged = ranged.sortWithinPartitions(*keys, *order).withColumn("__block", row).withColumn("__block", F.col("__block") - F.col("__block") % (1 << 33) % max(most // 2, 1))
        return Blocks(cold.withColumn("__block", F.lit(-1)).unionByName(keep(ranged)), keys, order, True)

    def scan(self, last: dict[str, str] | None = None, sums: dict[str, str] | None = None, previous: dict[str, str] | None = None) -> Blocks:
        """Add columns, named by the keys of the arguments, from the columns they name, in the order of each key's rows.

        last: the newest value that is not null, this row included. sums: the sum so far, this row included; null counts
        as 0. previous: the value in the row before, null in the first.

        Within a block these are windows. What a block hands on is one row for each of its keys; a second window over
        those rows gives each block its carry, and a join adds it.
        """
        last, sums, previous = last or {}, sums or {}, previous or {}
        w = Window.partitionBy("__block", *self.keys).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = self.rows.withColumns(
            {n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()}
            | {n: F.sum(F.coalesce(c, F.lit(0))).over(upto) for n, c in sums.items()}
            | {n: F.lag(c).over(w) for n, c in previous.items()}
            | ({"__at": F.row_number().over(w)} if previous else {})
        )
        if not self.split:
            return replace(self, rows=rows.drop("__at"))
        place = F.struct(*self.order)
        ends = self.rows.where("__block >= 0").groupBy("__block", *self.keys).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__c_{n}") for n, c in last.items()],
            *[F.sum(c).alias(f"__c_{n}") for n, c in sums.items()],
            *[F.max_by(F.struct(c), place).alias(f"__c_{n}") for n, c in previous.items()],
        )
        before = Window.partitionBy(*self.keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carry = [F.last(f"__c_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in (*last, *previous)]
        carry += [F.sum(f"__c_{n}").over(before).alias(f"__c_{n}") for n in sums]
        carries = keep(ends.select(F.col("__block").alias("__b"), *[F.col(k).alias(f"__k_{k}") for k in self.keys], *carry))
        on = reduce(lambda a, k: a & rows[k].eqNullSafe(carries[f"__k_{k}"]), self.keys, rows["__block"] == carries["__b"])
        both = rows.join(carries, on, "left").withColumns(
            {n: F.coalesce(n, f"__c_{n}") for n in last}
            | {n: F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums}
            | {n: F.when(F.col("__at") == 1, F.col(f"__c_{n}").getField(c)).otherwise(F.col(n)) for n, c in previous.items()}
        )
        return replace(self, rows=both.drop("__at", "__b", *[f"__k_{k}" for k in self.keys], *[f"__c_{n}" for n in (*last, *sums, *previous)]))

    def done(self) -> DataFrame:
        return self.rows.drop("__block")


def global_ranks(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """All rows with their place in one order over the whole table: row_number, rank, dense_rank, total_rows; and running ``sums``.

    Rows go by range into blocks, ranked each for itself; then what is before a block is added: its rows, its distinct
    places, its sums. These are counted by block, so that what passes through the driver is a row for each block, and no
    task sees more than a block. Rows of equal order are in one block. Nulls first. Ranks of rows that ``order`` does
    not tell apart are row_number's choice, as in a window.
    """
    sums = sums or {}
    spark = df.sparkSession
    places = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *places).withColumn("__block", F.spark_partition_id())
    ranged = keep(ranged)
    w = Window.partitionBy("__block").orderBy(*places)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns(
        {"row_number": F.row_number().over(w), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)} | {n: F.sum(F.coalesce(c, F.lit(0))).over(upto) for n, c in sums.items()}
    )
    counted = ranged.groupBy("__block", *order).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{n}") for n, c in sums.items()])
    ends = counted.groupBy("__block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), *[F.sum(f"s_{n}").alias(f"s_{n}") for n in sums])
    blocks = sorted(ends.collect(), key=lambda r: r["__block"])  # a row for each partition
    kinds = {n: local.schema[n].dataType for n in sums}
    now, out = [0, 0, *[0 for _ in sums]], []
    for r in blocks:
        out.append((r["__block"], *now))
        now = [now[0] + r["n"], now[1] + r["places"], *[a + (r[f"s_{n}"] or 0) for a, n in zip(now[2:], sums)]]
    names = ["n", "places", *[f"s_{n}" for n in sums]]
    fields = [StructField("__block", IntegerType()), StructField("__n", LongType()), StructField("__places", LongType()), *[StructField(f"__s_{n}", k) for n, k in kinds.items()]]
    exact = [(r[0], r[1], r[2], *[_as(k, v) for k, v in zip(kinds.values(), r[3:])]) for r in out]
    offsets = spark.createDataFrame(exact, StructType(fields))
    ranked = local.join(F.broadcast(offsets), "__block").withColumns(
        {"row_number": F.col("row_number") + F.col("__n"), "rank": F.col("rank") + F.col("__n"), "dense_rank": F.col("dense_rank") + F.col("__places"), "total_rows": F.lit(now[0]).cast("long")}
        | {n: (F.col(n) + F.col(f"__s_{n}")).cast(kinds[n]) for n in sums}
    )
    return ranked.drop("__block", *[f"__{n}" for n in names])


def _as(kind: DataType, v):
    return Decimal(v) if isinstance(kind, DecimalType) else float(v) if isinstance(kind, DoubleType) else v
