"""State of each key with event-time timers, outer joins of streams, and runs over what has come since the last."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from brindle.session import ship
from brindle.sources.snapshots import Snapshots

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as state variables need; the session's own setting comes back."""
    had = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if had is None else spark.conf.set(_STORE, had)


class Spells(StatefulProcessor):
    """Spells of a key's events no further apart than a gap, each given out once it has ended.

    State: the open spell's first and last event and their number, and how many spells have ended. A timer at the end of
    the gap after the last event gives the spell out when the watermark has passed it; a later event moves the timer.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, ended long, n long")
        self.ended = handle.getValueState("ended", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = sorted(v for part in rows for v in part["us"].tolist())
        was = self.open.get() if self.open.exists() else None
        spell = list(was) if was else None
        out = []
        for us in at:
            if spell and us - spell[1] > self.gap * 1000:
                out.append(self._done(key, spell))
                spell = None
            spell = [min(us, spell[0]), max(us, spell[1]), spell[2] + 1] if spell else [us, us, 1]
        if was:
            self.handle.deleteTimer(self._due(was[1]))
        self.open.update(tuple(spell))
        self.handle.registerTimer(self._due(spell[1]))
        yield pd.DataFrame(out, columns=["user_id", "spell", "started", "ended", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spell = self.open.get()
        self.open.clear()
        yield pd.DataFrame([self._done(key, spell)], columns=["user_id", "spell", "started", "ended", "n"])

    def _due(self, us: int) -> int:
        return us // 1000 + self.gap + 1

    def _done(self, key, spell) -> tuple:
        number = (self.ended.get()[0] if self.ended.exists() else 0) + 1
        self.ended.update((number,))
        return (key[0], number, *spell)

    def close(self) -> None:
        pass


def spells(events: DataFrame, gap_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(user_id, spell, started, ended, n) of each user's spells of events, appended when they have ended. events: (user_id, ts)."""
    ship(events.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that prepares the state is not given files sent to workers
    rows = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    found = rows.select("user_id", "us", "ts").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Spells(gap_seconds * 1000), outputStructType=StructType.fromDDL("user_id long, spell long, started long, ended long, n long"), outputMode="Append", timeMode="EventTime"
    )
    return found.select("user_id", "spell", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "n")


def followed_or_not(events: DataFrame, first: str, then: str, within: str, late: str = "0 seconds") -> DataFrame:
    """Like events.followed_by, but an event with nothing after it is given out too, with a null, when the watermark has passed its time."""
    side = lambda kind, id_, at: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(id_), F.col("user_id").alias(f"{id_}_user"), F.col("ts").alias(at)).withWatermark(at, late)
    a, b = side(first, first, "__from"), side(then, then, "__to")
    near = (F.col("__to") > F.col("__from")) & (F.col("__to") <= F.col("__from") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(f"{first}_user") == F.col(f"{then}_user")) & near, "left_outer").select(first, then)


def run_on(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Go on over what has come since the last run with this checkpoint, until nothing is left; in append mode into Parquet.

    In update mode ``path`` is a snapshot table (see snapshots.Snapshots): the rows of each batch take the place of those
    with their keys, and a batch that is run again after a failure counts once.
    """
    spark = df.sparkSession
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocks_store(spark):
        if mode == "append":
            started = out.format("parquet").start(path)
        else:
            started = out.foreachBatch(lambda batch, n: Snapshots(batch.sparkSession, path).upsert(batch, batch=n)).start()
        started.awaitTermination()
    return started
