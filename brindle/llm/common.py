"""What the operators of this folder share: word rules, tables that cut lineage, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\r\x0b\x0c"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """In local mode, give the Python workers this package wherever they were started.

    On a cluster the package is installed, on PYTHONPATH or sent by --py-files.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local[") or getattr(sc, "_brindle_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(), "brindle_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "brindle").rglob("*.py"):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(target)
    sc._brindle_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, local mode takes a temporary one; a cluster is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that keep() wrote and nothing has dropped yet.
_written: list[str] = []


def keep(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no more than the step at hand,
    and gives Spark the true size of the table for its choice of joins. Such tables stay until
    drop_kept(), as what an operator returns may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Delete the tables of keep(), save those that ``but`` reads; for when results are written."""
    needed = " ".join(but.inputFiles()) if but is not None else ""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _written if p.rsplit("/", 1)[1] not in needed]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.remove(path)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that columns put beside it can't clash with any."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names, null equal to null; the keys of the left side stay."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"__{k}"])
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


#: Bits of one bitmap, and the most bitmaps that are broadcast: 16 MB in all.
MAP_BITS, MOST_MAPS = 32768, 4096


def maybe_in(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows with a boolean ``maybe``, true for each whose columns ``on`` are in keys and for few others; nothing of rows is shuffled.

    What is broadcast is a bitmap of the keys' hashes with 64 bits a key, MOST_MAPS * 4 KB at most. With more keys
    than that has room for, more rows are true, so whoever asks decides these exactly, by a join of those alone.
    """
    maps = min(MOST_MAPS, max(1, -(-64 * keys.count() // MAP_BITS)))
    code = F.xxhash64(*on)
    at, bit = F.pmod(F.shiftright(code, 15), F.lit(maps)).cast("int").alias("__map"), code.bitwiseAND(F.lit(MAP_BITS - 1)).cast("int")
    bitmaps = keep(keys.select(at, bit.alias("bit")).repartition("__map").groupBy("__map").agg(F.bitmap_construct_agg("bit").alias("__bits")))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.expr("shiftright(__byte, __bit) % 2 = 1")
    rows = rows.withColumn("__map", at).join(F.broadcast(bitmaps), "__map", "left").withColumns({"__byte": byte, "__bit": bit.bitwiseAND(F.lit(7))})
    return rows.withColumn("maybe", F.coalesce(found, F.lit(False))).drop("__map", "__bits", "__byte", "__bit")


def sliced(batches, rows: int = 1000):
    """Arrow batches of at most so many rows, to bound what a Python worker holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signed(h: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return h - (1 << 64) if h >> 63 else h


def _marked(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b), both long: (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds: each node links to the smallest
    neighbour, until all components are stars. Every round is two grouped minima
    and two joins of tables in the shared folder; a hub's rows are split by
    Spark's skew join. Rounds grow with the logarithm of the longest chain. Nodes
    without a link to another node are not in the result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = keep(edges.distinct())
    mark = _marked(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = now.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        large = keep(large.distinct())
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        was, mark, now = mark, _marked(after), after
        if mark == was:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
