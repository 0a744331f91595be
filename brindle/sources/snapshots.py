"""Tables with versions: changes are merged by key into the buckets they touch and published by one rename."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files that a bucket is written in, at most: what one task of a write holds is a bucket over this.
SPREAD = 8


class Snapshots:
    """A table at ``path``: Parquet folders under ``data``, and for each version a manifest that names those it is made of.

    Rows are in buckets by a hash of their keys. A change writes the buckets it touches anew, in a folder of its own, and
    then a manifest, which appears whole or not at all. So readers see one version or the other, a write that fails
    leaves the old one, and of two writers that began at one version the second is refused. Keys may be null and are then
    equal; a key has one row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(self._conf)
        self._jvm = jvm

    @staticmethod
    def create(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> Snapshots:
        made = Snapshots(df.sparkSession, path)
        if made.versions():
            raise ValueError(f"there is a table at {path}")
        made._publish(0, {"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue(), "batch": -1, "folders": made._write(df, keys, buckets)})
        return made

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found or version is not None and version not in found:
            raise ValueError(f"no version {version} at {self.path}")
        name = f"{self.path}/manifests/v{found[-1] if version is None else version:010d}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.option("wholetext", "true").text(name).collect()))  # one small file

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        return self._folders(list(found["folders"].values()), StructType.fromJson(found["schema"]))

    def upsert(self, changes: DataFrame, gone: str | None = None, batch: int | None = None) -> int:
        """Rows of ``changes`` take the place of those with their keys, or are added; where the column ``gone`` is true they are only taken out.

        ``changes`` has the table's columns, in any order, besides ``gone``. Two changes of one key are refused. Untouched
        buckets stay as they are. With ``batch`` (the number of a stream's batch) a batch that the table has had changes nothing.
        Returns the version that has the changes.
        """
        last = self.versions()[-1]
        now = self.manifest(last)
        if batch is not None and batch <= now["batch"]:
            return last
        keys, buckets, schema = now["keys"], now["buckets"], StructType.fromJson(now["schema"])
        if not changes.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("two changes of one key")
        placed = changes.withColumn("__bucket", self._bucket(keys, buckets))
        touched = [str(r[0]) for r in placed.select("__bucket").distinct().collect()]  # no more than there are buckets
        old = self._folders([now["folders"][b] for b in touched if b in now["folders"]], schema)
        named = changes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
        on = reduce(lambda a, b: a & b, [old[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)])
        new = (changes.where(~F.coalesce(F.col(gone), F.lit(False))) if gone else changes).select(*schema.names)
        merged = old.join(named, on, "left_anti").unionByName(new)
        folders = {b: f for b, f in now["folders"].items() if b not in touched} | self._write(merged, keys, buckets)
        self._publish(last + 1, now | {"folders": folders, "batch": now["batch"] if batch is None else batch})
        return last + 1

    def forget(self, newest: int) -> None:
        """Delete all versions but the ``newest`` ones, and the folders that only those read or that no version does."""
        found = self.versions()
        kept = {f.split("/")[0] for v in found[-newest:] for f in self.manifest(v)["folders"].values()}
        for v in found[:-newest]:
            self._fs.delete(self._at(f"{self.path}/manifests/v{v:010d}.json"), False)
        for f in self._fs.listStatus(self._at(f"{self.path}/data")):
            if f.getPath().getName() not in kept:
                self._fs.delete(f.getPath(), True)

    def _folders(self, folders: list[str], schema: StructType) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(keys: list[str], buckets: int):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        name = uuid.uuid4().hex
        out = f"{self.path}/data/{name}"
        placed = df.withColumns({"__bucket": self._bucket(keys, buckets), "__part": F.pmod(F.hash(*keys), F.lit(SPREAD))})
        placed.repartition("__bucket", "__part").drop("__part").write.partitionBy("__bucket").parquet(out)
        found = [f.getPath().getName() for f in self._fs.listStatus(self._at(out))]
        return {n.split("=")[1]: f"{name}/{n}" for n in found if n.startswith("__bucket=")}

    def _publish(self, version: int, manifest: dict) -> None:
        """Write the manifest beside its place, then rename it, which fails where another writer was first."""
        draft = self._at(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"{self.path}/manifests/v{version:010d}.json")), none)
        except Exception as e:
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was not published") from e
