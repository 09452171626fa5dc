"""The corpus pipeline over documents: reject bad text, drop repeated lines and near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The result of a stage is
written as Parquet and read again as the next one's docs; all but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, line_dedup, mixing, near_dup, quality
from gleanery.llm.catalog import vocabulary_path
from gleanery.llm.store import dropped, kept, sized, table, temporary, written

#: Words of a shingle and percent of similarity for near copies.
SHINGLE, PERCENT = 5, 80
#: Begins the names of the stages' own columns, which no table has.
OWN = "_stage_"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.judged(docs, table(spark, sf_dir, "labels"), prefix=OWN).where(f"{OWN}kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier documents have; their number of characters follows."""
    out = line_dedup.dedup(docs, prefix=OWN)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(f"{OWN}n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.deduplicated(docs, k=SHINGLE, percent=PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole."""
    return mixing.mix(docs, prefix=OWN).where(f"{OWN}copies > 0").withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), F.col(f"{OWN}copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of each document, their number, and the digests of ids and decoded text."""
    sized(spark)
    return bpe.digests(docs, vocabulary_path(), carry=("doc_id", "lang", "source"), ids_too=True)


STAGES = [("quality classifier", classify), ("line dedup", drop_lines), ("near dedup", drop_copies), ("mixing", mix), ("bpe", encode)]

#: SQL expresses neither the language model nor the mix; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        # A stage's own tables go when its result is written, and that when the next one's is.
        with temporary():
            docs = kept(written(stage(spark, docs, sf_dir)))
        if before is not None:
            dropped(before)
        before = docs
    return docs
