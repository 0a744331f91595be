"""Sharding by extendible hashing: only shards above their byte limit split on another hash bit. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, null_safe, whole_row

BITS, ROUND = 60, 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a long."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, oversized) for each row.

    The directory starts with one shard of depth 0. A shard whose texts have more than ``limit`` bytes
    splits on the next bit of the ids' hash, until every shard fits; others stay. The directory is found
    by summing bytes by hash prefix, ROUND bits at once: the depth of a shard is the first at which its
    prefix fits. Only rows of prefixes still above the limit go to the next round. shard: the prefix's
    bits as text, after "s".

    A document above the limit and documents of one id can't be split from themselves: they are in a shard
    of all 60 bits, oversized. Null text: 0 bytes. Null id: as the empty text. Repeated rows go to one
    shard. Empty table: no rows. Other columns are not read.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(key).alias("h"))
    todo = keep(rows)
    done, base = None, 0
    while True:
        top = base + ROUND
        sizes = todo.groupBy(F.expr(f"shiftright(h, {BITS - top})").alias("p")).agg(F.sum("n_bytes").alias("b"))
        every = sizes.select("b", "p", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        every = every.select("b", "p", "depth", F.expr(f"p div cast(pow(2, {top} - depth) as bigint)").alias("q"))
        total = every.groupBy("depth", "q").agg(F.sum("b").alias("total"))
        fits = every.join(total, ["depth", "q"]).where((F.col("total") <= limit) | (F.lit(top == BITS) & (F.col("depth") == BITS)))
        place = keep(fits.groupBy("p").agg(F.min(F.struct("depth", "q", "total")).alias("s")))
        joined = todo.withColumn("p", F.expr(f"shiftright(h, {BITS - top})")).join(place, "p", "left")
        part = joined.where("s is not null").select("doc_id", "n_bytes", "s.depth", "s.q", F.col("s.total").alias("shard_bytes"))
        done = part if done is None else done.unionAll(part)
        if top == BITS or total.where(F.col("depth") == top).where(F.col("total") > limit).isEmpty():
            break
        todo, base = keep(joined.where("s is null").select("doc_id", "n_bytes", "h")), top
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(q), depth, '0')"))
    return done.select("doc_id", "n_bytes", F.concat(F.lit("s"), bits).alias("shard"), "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = 1 << 27, folder: str = "shard") -> None:
    """Write the documents as Parquet, a folder for each shard, named ``folder``=its bits; all columns as they are. Needs doc_id and text.

    A shard that can't be split, as one id or no id has more than ``limit`` bytes, is written by as many tasks as it has
    limits. Null ids and texts, repeated rows: see shards(). Empty table: no files. A column called ``folder`` is refused: name another.
    """
    if folder in docs.columns:
        raise ValueError(f"the documents have a column {folder!r}: name the folders otherwise")
    at = shards(docs, limit=limit).groupBy("doc_id").agg(F.first("shard").alias("shard"), F.max("shard_bytes").alias("bytes"))
    own = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    tasks = F.greatest(F.ceil(F.col("bytes") / limit), F.lit(1))
    both = null_safe(own, at, ["doc_id"]).select("row", "shard", F.pmod(F.monotonically_increasing_id(), tasks).alias("task"))
    both.repartition("shard", "task").select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
