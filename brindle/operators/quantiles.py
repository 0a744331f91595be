"""Exact quantiles of groups of any size: ranges narrowed by histograms until the rank is found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.scan import MOST, hot_keys, parted
from brindle.session import keep

#: Bins of a histogram in a round.
BINS = 1024


def _bin(v: Column, low: Column, high: Column, turn: int) -> Column:
    """A bin from 0 to BINS - 1 that never falls as v grows; low is alone in the first and high in the last.

    Equal widths in even rounds, equal ratios in odd ones, so that neither bunched nor far-flung values need many rounds.
    """
    x, a, b = (c.cast("double") for c in (v, low, high))
    if turn % 2:
        x, a, b = (F.signum(c) * F.log1p(F.abs(c) * 1e6) for c in (x, a, b))
    at = F.coalesce(F.try_divide(x - a, b - a), F.lit(0.5))
    at = F.when(F.isnan(at), 0.5).otherwise(F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0)))
    return F.when(v == low, 0).when(v == high, BINS - 1).otherwise(F.least(F.lit(BINS - 2), 1 + F.floor(at * (BINS - 2)))).cast("int")


def ranked_values(df: DataFrame, group: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(group, rank, value): of each group the values at the ranks (from 0) that wanted (group, rank) names, nulls left out.

    A round counts, for each range still open, its rows by bin, and goes on with the bin that the rank is in, from its
    least to its greatest value. A range ends with one value. Partial counts are summed before the shuffle, so that a
    round moves at most BINS rows for each range and task; no group's values meet in a task. Rows outside all open ranges
    are dropped at the scan's side of the join, and each round is written, so that a later one starts there.
    """
    named = [F.col(g).alias(f"__g_{g}") for g in group]
    keys = [f"__g_{g}" for g in group]
    rows = df.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("__v"))
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("low"), F.max("__v").alias("high"))
    state = wanted.select(*named, F.col("rank").cast("long").alias("rank")).distinct()
    open_ = keep(_met(state, ends, keys).withColumn("below", F.lit(0).cast("long")))
    done = []
    turn = 0
    while True:
        done.append(open_.where("low <=> high").select(*keys, "rank", F.col("low").alias("value")))
        open_ = open_.where("not low <=> high")
        if open_.isEmpty():
            break
        inside = _met(rows, open_, keys).where("__v >= low and __v <= high")
        bins = inside.groupBy(*keys, "rank", "below", _bin(F.col("__v"), F.col("low"), F.col("high"), turn).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        summed = bins.withColumn("to", F.col("below") + F.sum("n").over(upto))
        found = summed.where("rank < to and rank >= to - n")
        open_ = keep(found.select(*keys, "rank", "low", "high", (F.col("to") - F.col("n")).alias("below")))
        turn += 1
    out = reduce(DataFrame.unionAll, done)
    return out.select(*[F.col(f"__g_{g}").alias(g) for g in group], "rank", "value")


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, null equal to null, the left side's keys kept."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, k: a & left[k].eqNullSafe(named[f"__r_{k}"]), keys, F.lit(True))
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, tuple[float, str]], most: int = MOST) -> DataFrame:
    """(group, one column for each of wanted): {name: (fraction, "cont" or "disc")}, as percentile_cont and percentile_disc.

    No group: one row for the whole table. Nulls are left out; a group without other values has nulls. Groups of at most ``most`` rows are
    sorted each in a task; for larger ones see ranked_values. NaN is the largest value.
    """
    if not group:
        return quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, wanted, most).drop("__all")
    hot = hot_keys(df, group, most)
    number = F.col(value).cast("double")
    place = lambda f: F.greatest(F.ceil(F.lit(f) * F.count(value)), F.lit(1)).cast("int")
    disc = {n: F.try_element_at(F.sort_array(F.collect_list(value)), place(f)) for n, (f, kind) in wanted.items() if kind == "disc"}
    cold, rest = parted(df, hot, group)
    small = cold.groupBy(*group).agg(*[disc[n].alias(n) if n in disc else F.percentile(number, F.lit(f)).alias(n) for n, (f, _) in wanted.items()])
    if hot.isEmpty():
        return small
    sizes = rest.groupBy(*group).agg(F.count(value).alias("__n"))
    ranks: list[Column] = []
    for n, (f, kind) in wanted.items():
        at = F.lit(f) * (F.col("__n") - 1)
        low = F.greatest(F.ceil(F.lit(f) * F.col("__n")) - 1, F.lit(0)) if kind == "disc" else F.floor(at)
        high = low if kind == "disc" else F.ceil(at)
        ranks.append(F.struct(F.lit(n).alias("name"), low.cast("long").alias("low"), high.cast("long").alias("high"), (F.lit(0.0) if kind == "disc" else at - F.floor(at)).alias("part")))
    asked = keep(sizes.withColumn("__q", F.explode(F.array(*ranks))).select(*group, "__n", "__q.*"))
    some = asked.where("__n > 0")
    values = keep(ranked_values(rest, group, value, some.select(*group, F.explode(F.array("low", "high")).alias("rank"))))
    low, high = values.withColumnsRenamed({"rank": "low", "value": "__x"}), values.withColumnsRenamed({"rank": "high", "value": "__y"})
    both = _met(_met(asked, low, [*group, "low"], "left"), high, [*group, "high"], "left")
    between = F.col("__x").cast("double") + (F.col("__y").cast("double") - F.col("__x").cast("double")) * F.col("part")
    large = both.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, F.col("__x") if n in disc else between)).alias(n) for n in wanted])
    return small.unionByName(large)
