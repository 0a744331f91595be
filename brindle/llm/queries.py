"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .conversation_repair import conversation_repair
from .embedding_dedup import embedding_links
from .language_id import language_id
from .lm_scoring import score_documents
from .mixing import mix
from .oracle import ORACLE_SQL
from .packing import pack
from .quality_rules import quality_rules
from .secret_scan import joined, secret_scan
from .sharding import shards
from .simhash import simhash_dedup
from .substring_dedup import window_removal
from .warc_derivatives import derivatives
from .whitening import whiten

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_path"]

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A vocabulary file; by default the one that ``op9`` and the pipeline pack by."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(read(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("spans"), 256).alias("base_sha256"), joined("every").alias("spans"), "n_live", "n_shared")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_removal(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(read(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"), tokenizer_path(PIECES))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_warc_derivatives, op3_secret_scan, op4_mix_sources, op5_embedding_dedup,
        op6_simhash_dedup, op7_extendible_sharding, op8_substring_dedup, op9_best_fit_packing, op10_quality_rules,
        op11_embedding_whitening, op12_conversation_repair, op13_language_id,
    )
}
