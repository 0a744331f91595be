"""Patterns of events: one step after the other, within time limits, with nothing forbidden between."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.scan import MOST, Blocks


@dataclass(frozen=True)
class Step:
    """An event of a pattern: when it is one, how many seconds after the step before at most, and what must not come between."""

    name: str
    when: Column
    within: float | None = None
    unless: Column | None = None


def sequences(df: DataFrame, keys: list[str], time: str, id_: str, steps: list[Step], most: int = MOST) -> DataFrame:
    """(keys, one column of ids for each step): a row for each event of the first step from which all others follow.

    From each step the automaton takes the first later event of the key that is the next step or is forbidden before it;
    with a forbidden one, or one that is both, or beyond the limit, the first event matches nothing. Later is by time, then id;
    ids tell the rows of a key apart. Rows with a null time or id are left out; null keys are a key of their own.

    The fold runs backwards: one pass of the rows in reverse order tells each what comes next, and so, step by
    step, the whole rest of its match. Keys of more than ``most`` events go in blocks (see scan.Blocks).
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    flags = {f"__is{k}": F.coalesce(s.when, F.lit(False)) for k, s in enumerate(steps)} | {f"__no{k}": F.coalesce(s.unless, F.lit(False)) if s.unless is not None else F.lit(False) for k, s in enumerate(steps)}
    rows = df.where(F.col(time).isNotNull() & F.col(id_).isNotNull()).select(*keys, F.col(id_).alias("__id"), us.alias("__us"), *[c.alias(n) for n, c in flags.items()])
    rows = rows.withColumns({"__back": -F.col("__us"), "__first": -F.xxhash64("__id") if rows.schema["__id"].dataType.simpleString() == "string" else -F.col("__id")})
    blocks = Blocks.of(rows, keys, ["__back", "__first"], most)
    last = len(steps) - 1
    chain = F.when(F.col(f"__is{last}"), F.struct(F.col("__id").alias(f"i{last}")))
    for k in range(last - 1, -1, -1):
        follows = F.when(F.col(f"__is{k + 1}") & ~F.col(f"__no{k + 1}"), chain)
        event = F.when(F.col(f"__is{k + 1}") | F.col(f"__no{k + 1}"), F.struct(F.col("__us").alias("us"), follows.alias("rest")))
        blocks = replace(blocks, rows=blocks.rows.withColumn("__event", event)).scan(last={"__next": "__event"}).scan(previous={"__then": "__next"})
        near = F.col("__then.rest").isNotNull()
        if steps[k + 1].within is not None:
            near &= F.col("__then.us") - F.col("__us") <= int(steps[k + 1].within * 1_000_000)
        own = F.struct(F.col("__id").alias(f"i{k}"), *[F.col(f"__then.rest.i{j}").alias(f"i{j}") for j in range(k + 1, last + 1)])
        named = f"__chain{k}"
        blocks = replace(blocks, rows=blocks.rows.withColumn(named, F.when(F.col(f"__is{k}") & near, own)).drop("__event", "__next", "__then"))
        chain = F.col(named)
    found = blocks.done().withColumn("__match", chain).where("__match is not null")
    return found.select(*keys, *[F.col(f"__match.i{k}").alias(s.name) for k, s in enumerate(steps)])
