"""Session settings and table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def session(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; the cluster's own settings stay."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    for k, v in wanted.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables, for SQL text."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, local mode takes a temporary one; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths written inside scratch(), innermost last; each thread of work has its own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def new_path(spark: SparkSession, what: str = "table") -> str:
    """A fresh place in the shared folder; deleted on leaving scratch(), if inside one."""
    path = f"{shared_dir(spark)}/brindle-{what}-{uuid.uuid4().hex}"
    if _scratch.get():
        _scratch.get()[-1].append(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no more than the step at hand, and gives
    Spark the true size of the table for its choice of joins.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, what keep() and new_path() wrote inside: and nothing of any other query.

    Results must be written or collected inside, as they may read such tables.
    """
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def ship(spark: SparkSession) -> None:
    """In local mode, give the Python workers this package wherever they were started.

    On a cluster the package is installed, on PYTHONPATH or sent by --py-files.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local[") or getattr(sc, "_brindle_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), "brindle_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "brindle").rglob("*.py"):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(target)
    sc._brindle_sent = True
