"""First-wins and last-wins deduplication over an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """Of the rows of a key the first in order."""
    return _ranked(df, keys, [F.asc(o) for o in order])


def last_wins(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order."""
    return _ranked(df, keys, [F.desc(o) for o in order])


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As last_wins by a partial aggregate, so a key with very many rows needs no sort: for results, runs and profiles of a slug."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_r")).select(*keys, "_r.*")
