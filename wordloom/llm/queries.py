"""The registered queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, ship
from . import sql
from .decontaminate import contaminated
from .hard_negatives import hard_negatives, usable_vectors
from .language_id import identify_language
from .license_scan import license_scan
from .line_frequency import line_frequency
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import pack_documents
from .prefix_trie import rebuilt_trie
from .substring import remove_repeats
from .token_shards import document_keys, write_shards
from .toxicity import score_toxicity
from .url_cascade import judge_urls

BLOCKED = ["net/", "example.com/de/"]
ALLOWED = ["example.net/en/", "org/fr/"]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public tokenizer; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), BLOCKED, ALLOWED)


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = write_shards(docs, Scratch(spark, "shards").path("store"), tokenizer_file())
    return store.digests(document_keys(docs)).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable_vectors(_table(spark, sf_dir, "embeddings").withColumn("label", moved)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_url_cascade": op5_url_cascade,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_line_frequency": op9_line_frequency,
    "op10_token_shards": op10_token_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_mix": op13_source_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": sql.license_scan(),
    "op5_url_cascade": sql.url_rules(BLOCKED, ALLOWED),
    "op9_line_frequency": sql.line_frequency(),
    "op11_hard_negatives": sql.hard_negatives(),
    "op12_prefix_trie": sql.prefix_trie(),
    "op13_source_mix": sql.source_mix(),
}
