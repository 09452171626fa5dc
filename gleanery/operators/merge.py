"""Upserts, queue appends and snapshot differences, as full outer and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import filled
from gleanery.functions.urls import crawl_key, is_directory
from gleanery.operators.dedup import first_wins

METRICS = ("favorite_count", "retweet_count", "reply_count", "quote_count", "bookmark_count", "view_count")


def upsert_posts(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Known posts take new numbers and fill what was empty; others are added. change tells which: added, updated or same.

    Both sides have one row a key.
    """
    fill = ["text", "created_at"] if fill is None else fill
    metrics = [m for m in METRICS if m in old.columns and m in new.columns] if metrics is None else metrics
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]), "full_outer")
    both = F.col("o._o") & F.col("n._n")
    moved = [F.col(f"n.{m}").isNotNull() & ~F.col(f"n.{m}").eqNullSafe(F.col(f"o.{m}")) for m in metrics]
    filled_up = [filled(F.col(f"o.{c}")).isNull() & filled(F.col(f"n.{c}")).isNotNull() for c in fill]
    changed = reduce(lambda a, b: a | b, [*moved, *filled_up], F.lit(False))
    out = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    out += [F.when(filled(F.col(f"o.{c}")).isNull(), F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fill]
    out += [F.coalesce(f"n.{m}", f"o.{m}").alias(m) for m in metrics]
    rest = [c for c in old.columns if c not in {*keys, *fill, *metrics}]
    out += [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in rest]
    change = F.when(both & changed, "updated").when(both | F.col("o._o"), "same").otherwise("added")
    return joined.select(*out, change.alias("change"))


def not_queued(rows: DataFrame, queued: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in the queue yet."""
    return rows.join(queued.select(*keys), keys, "left_anti")


def mirror(source: DataFrame, copy: DataFrame) -> DataFrame:
    """What a mirror of files (path, content) has to do: path and action (copy, remove or keep)."""
    a = source.select("path", F.sha2("content", 256).alias("ha"))
    b = copy.select("path", F.sha2("content", 256).alias("hb"))
    action = F.when(F.col("ha").isNull(), "remove").when(F.col("ha").eqNullSafe(F.col("hb")), "keep").otherwise("copy")
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def mirror_counts(source: DataFrame, copy: DataFrame) -> DataFrame:
    m = F.col("action")
    return mirror(source, copy).agg(F.count_if(m == "copy").alias("copied"), F.count_if(m == "remove").alias("removed"), F.count_if(m != "remove").alias("total"))


def update_fields(businesses: DataFrame, changes: DataFrame, key: str = "slug") -> DataFrame:
    """Fields of changes overwrite those of businesses, but never with nothing, and a site never with a directory's."""
    b, c = businesses.alias("b"), changes.alias("c")
    out = []
    for name in businesses.columns:
        if name == key or name not in changes.columns:
            out.append(F.col(f"b.{name}"))
            continue
        new = F.col(f"c.{name}")
        if name == "website":
            new = F.when(~is_directory(new), new)
        out.append(F.coalesce(filled(new) if dict(businesses.dtypes)[name] == "string" else new, f"b.{name}").alias(name))
    return b.join(c, key, "left").select(*out)


def retried_pages(prior: DataFrame, again: DataFrame, ord_: str = "ord") -> DataFrame:
    """Pages of a run with those fetched again in their place; a page that failed again keeps its old record."""
    new = first_wins(again.where("status = 'ok'").withColumn("_key", crawl_key("url")), ["_key"], [ord_])
    columns = [c for c in prior.columns]
    p, n = prior.withColumn("_key", crawl_key("url")).alias("p"), new.alias("n")
    use = (F.col("p.status") != "ok") & F.col("n._key").isNotNull()
    return p.join(n, F.col("p._key") == F.col("n._key"), "left").select(*[F.when(use & F.lit(c not in (ord_,)), F.col(f"n.{c}")).otherwise(F.col(f"p.{c}")).alias(c) if c in again.columns else F.col(f"p.{c}") for c in columns])


def section_bullets(old: Column, new: Column) -> Column:
    """Bullets of a section with new ones added, none twice."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))


def corrected(rows: DataFrame, corrections: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows with the column emptied where a table of corrections lists it as wrong."""
    wrong = corrections.select(*keys, F.lit(True).alias("_wrong")).distinct()
    return rows.join(wrong, keys, "left").withColumn(column, F.when(F.col("_wrong"), F.lit(None)).otherwise(F.col(column))).drop("_wrong")
