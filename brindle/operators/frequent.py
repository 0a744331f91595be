"""Heavy hitters: bounded counters that merge choose candidates, a second pass counts them exactly."""

from __future__ import annotations

from math import ceil

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import keep, ship

#: Tables of counters that one task of the merge takes.
FAN_IN = 64


def shrunk(counts: dict, most: int) -> dict:
    """At most ``most`` counters: the next largest count is taken off all, and those not above it go.

    A value loses no more than all counts over (most + 1) in all, however tables are shrunk and added.
    """
    if len(counts) <= most:
        return counts
    off = sorted(counts.values(), reverse=True)[most]
    return {v: n - off for v, n in counts.items() if n > off}


def heavy_hitters(df: DataFrame, column: str, share: float) -> DataFrame:
    """(column, n): values with more than ``share`` of all rows, nulls left out, and how often each occurs, exactly.

    Each partition keeps 1 / share counters, and tables of counters are added and shrunk in a tree; no value above the
    share can be lost there. The candidates, 1 / share at most, are then counted in a second pass, which decides.
    Equal counts at the edge: none is above it. No rows: none.
    """
    if not 0 < share < 1:
        raise ValueError("a share lies between 0 and 1")
    most = ceil(1 / share)
    ship(df.sparkSession)
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    kind = rows.schema["value"].dataType.simpleString()
    ddl = f"value {kind}, n long, part long, total long"

    def count(batches):
        counts, total, arrow = {}, 0, None
        for batch in batches:
            arrow = batch.column(0).type
            total += batch.num_rows
            for v, n in zip(*(c.to_pylist() for c in pc.value_counts(batch.column(0)).flatten())):
                counts[v] = counts.get(v, 0) + n
            counts = shrunk(counts, most)
        if total:
            yield _table(counts, total, TaskContext.get().partitionId(), arrow).to_batches()[0]

    def _table(counts: dict, total: int, part: int, arrow) -> pa.Table:
        # the rows seen stand beside the first counter, or alone
        values, ns = (list(counts), list(counts.values())) if counts else ([None], [0])
        first = [total] + [0] * (len(values) - 1)
        return pa.table({"value": pa.array(values, arrow), "n": pa.array(ns, pa.int64()), "part": pa.array([part] * len(values), pa.int64()), "total": pa.array(first, pa.int64())})

    def merge(table: pa.Table) -> pa.Table:
        counts: dict = {}
        for v, n in zip(table["value"].to_pylist(), table["n"].to_pylist()):
            if v is not None:
                counts[v] = counts.get(v, 0) + n
        return _table(shrunk(counts, most), pc.sum(table["total"]).as_py(), table["part"][0].as_py(), table["value"].type)

    found = keep(rows.mapInArrow(count, ddl))
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        found = keep(found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, ddl))
    total = found.agg(F.sum("total")).first()[0] or 0
    candidates = F.broadcast(found.where("value is not null").select("value"))  # 1 / share rows at most
    exact = rows.join(candidates, "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") > share * total).select(F.col("value").alias(column), "n")
