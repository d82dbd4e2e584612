"""The registered queries of this subpackage, and their SQL where SQL can
express them.  Each applies an operator with production parameters to its
whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import sql
from foldspark.llm._common import prepare, size_of_text
from foldspark.llm.embedding_dedup import near_duplicates
from foldspark.llm.filter_audit import filter_audit
from foldspark.llm.language_id import identify
from foldspark.llm.line_dedup import line_dedup
from foldspark.llm.mixing import mix
from foldspark.llm.ngram_join import ngram_join
from foldspark.llm.packing import pack
from foldspark.llm.quality_rules import quality_rules
from foldspark.llm.sharding import shard
from foldspark.llm.spelling import spelling_variants
from foldspark.llm.substring_dedup import substring_dedup
from foldspark.llm.suffix_dedup import suffix_dedup
from foldspark.llm.token_counts import token_counts


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", size_of_text(F.col("text")).alias("n_bytes"), "text")
    return token_counts(docs, vocabulary("word_bpe_49k.json")).drop("text")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": sql.LINE_DEDUP,
    "op2_ngram_join": sql.NGRAM_JOIN,
    "op3_substring_dedup": sql.SUBSTRING_DEDUP,
    "op5_embedding_dedup": sql.EMBEDDING_DEDUP,
    "op8_quality_rules": sql.QUALITY_RULES,
    "op10_mixing": sql.MIXING,
    "op11_suffix_dedup": sql.SUFFIX_DEDUP,
    "op12_spelling_variants": sql.SPELLING_VARIANTS,
    "op13_filter_audit": sql.FILTER_AUDIT,
}
