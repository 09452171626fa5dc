"""The registered queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, chat, compression, line_dedup, main_text, media, mixing, near_dup, neighbours, quality, secrets, vector_dedup, whitening
from gleanery.llm.store import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabularies lie; any other path serves as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.groups(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.groups(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select(F.col("k").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", F.round("nll", 6).alias("nll"), F.round(F.exp("nll"), 4).alias("perplexity"), F.round("own", 6).alias("own"), "fluent", "kept")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op11_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compressed(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_chat": op3_chat,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_secrets": op5_secrets,
    "op6_main_text": op6_main_text,
    "op7_near_dup": op7_near_dup,
    "op8_quality": op8_quality,
    "op9_neighbours": op9_neighbours,
    "op10_line_dedup": op10_line_dedup,
    "op11_media": op11_media,
    "op12_compression": op12_compression,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op4_vector_dedup": vector_dedup.ORACLE_SQL, "op7_near_dup": near_dup.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL, "op12_compression": compression.ORACLE_SQL}
