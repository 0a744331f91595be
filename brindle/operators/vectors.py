"""Search of a set of query vectors against all rows, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows that meet in one task: what bounds its memory, with their products.
QUERIES, ROWS = 1024, 8192


def _by_size(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{size: (ids, vectors as rows)}"""
    vectors = pa.chunked_array(table["v"].chunks, table["v"].type).combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = table["id"].to_numpy()[at], vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
    return out


def cosine_search(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, least: float, digits: int = 6) -> DataFrame:
    """(a, b, cos): each query a with each row b of another id whose cosine, rounded to so many digits, is above ``least``.

    Every query meets every row, whatever else the rows hold: in cells of a block of either, dealt by hash, multiplied as matrices
    in double precision. Null, empty and zero vectors, ones with null or non-finite entries, and pairs of unequal size meet nothing.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fit = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    q, r = fit(queries), fit(rows)
    many = [max(1, -(-df.count() // size)) for df, size in ((q, QUERIES), (r, ROWS))]
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    cell = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("i", block(many[0])).withColumn("j", cell(many[1])).groupBy("i", "j")
    right = r.withColumn("j", block(many[1])).withColumn("i", cell(many[0])).groupBy("i", "j")

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        sides = [_by_size(x), _by_size(y)]
        for d in set(sides[0]) & set(sides[1]):
            (a, u), (b, w) = sides[0][d], sides[1][d]
            u, w = (m / np.abs(m).max(axis=1, keepdims=True) for m in (u, w))
            cos = np.round((u @ w.T) / np.outer(np.sqrt((u * u).sum(axis=1)), np.sqrt((w * w).sum(axis=1))), digits)
            at = np.nonzero((cos > least) & (a[:, None] != b[None, :]))
            for o, v in zip(out, (a[at[0]], b[at[1]], cos[at])):
                o.append(v)
        return pa.table({n: np.concatenate(o) for n, o in zip(("a", "b", "cos"), out)})

    return left.cogroup(right).applyInArrow(meet, "a long, b long, cos double")
