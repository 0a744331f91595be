"""A training corpus from ``documents``: five stages of brindle.llm, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import mixing, near_copies, packing, quality_rules, secret_scan
from brindle.llm.common import keep
from brindle.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of a source share.

    Null and empty texts go, as they have too few words. Repeated rows share a verdict and all stay. Null ids and sources: as
    any other. Very long texts: whole. Empty table: no rows. Other columns are carried, whatever their names.
    """
    return quality_rules.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles or SimHash: the one with the smallest doc_id.

    Null and empty texts are copies of each other. A null id comes after all others. Repeated rows, and texts of a group under
    one id, stay once. Very long texts: whole. Empty table: no rows. Other columns are carried.
    """
    return near_copies.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live credentials replaced by a mark.

    Null texts stay null. Repeated rows: each stays, marked alike. Null ids and sources: as any other. Very long texts: whole.
    Empty table: no rows. Other columns are carried.
    """
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it.

    Null and empty texts have no words and stay as they are, once. Repeated rows: each is a document. A null source is one
    of its own, null ids are as any other. Empty table: no rows. Other columns are carried.
    """
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null texts are as empty ones: the end alone. Repeated rows: each is packed. Null ids: kept. Very long texts: cut into pieces of
    2048. Empty table: no rows. Of other columns none is returned.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixture", mixture), ("packed", packed)]

#: SimHash needs XXH64 and the mix random draws by it, which DuckDB's SQL lacks; tests/llm holds brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
