"""One call for each file format, schemas given where the format has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Null in a CSV file: an empty field would be read as the empty text is.
NULL = "\\N"

#: Formats and the options that make a round trip exact.
FORMATS = {
    "parquet": {},
    "orc": {},
    "json": {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"},
    "csv": {
        "header": "true", "quote": '"', "escape": '"', "multiLine": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": NULL,
    },
    "xml": {"rowTag": "row", "rootTag": "rows", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    "text": {},
}


def _texts(df: DataFrame, pattern: str, change) -> DataFrame:
    """Texts of a CSV file that match are changed, others are as they are."""
    names = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    like = lambda c: c.startswith("\\") & c.rlike(pattern)
    return df.withColumns({n: F.when(like(F.col(f"`{n}`")), change(F.col(f"`{n}`"))).otherwise(F.col(f"`{n}`")) for n in names})


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """In CSV null is \\N, and a text that is itself backslashes and an N gets one backslash more, which read() takes off."""
    if fmt == "csv":
        df = _texts(df, r"^\\+N\z", lambda c: F.concat(F.lit("\\"), c))
    out = df.write.format(fmt).options(**FORMATS[fmt]).mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """Text formats need their schema: no pass over the data to guess it."""
    if schema is None and fmt in ("json", "csv", "xml"):
        raise ValueError(f"{fmt} needs a schema")
    found = spark.read.format(fmt).options(**FORMATS[fmt])
    df = (found.schema(schema) if schema else found).load(path)
    return _texts(df, r"^\\{2,}N\z", lambda c: F.substr(c, F.lit(2))) if fmt == "csv" else df


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files whose names match, each file whole in one row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by its keys, so that joins on them need no shuffle; in the warehouse, or at a path."""
    out = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(name)
