"""Writers: queues, slim rows, run reports, rendered notes and digests. Spark's commit makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import filled
from gleanery.operators.merge import not_queued


def append_queue(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends rows whose key the queue at path lacks; returns what was appended."""
    spark = rows.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        rows = not_queued(rows, spark.read.schema(rows.schema).json(path), keys)
    rows.write.mode("append").json(path)
    return rows


def write_json(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).json(path)


def run_report(rows: DataFrame, status: str, sample: str, most: int = 10) -> DataFrame:
    """One row a status: how many, and a few samples in order."""
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(sample)), 1, most).alias("samples"))


def front_line(key: str, value: Column) -> Column:
    """A line of front matter; quotes in values become apostrophes."""
    return F.concat(F.lit(f'{key}: "'), F.regexp_replace(F.coalesce(value, F.lit("")), '"', "'"), F.lit('"'))


def rendered_notes(businesses: DataFrame) -> DataFrame:
    """slug and the note document of each business."""
    link = lambda c: F.concat(F.lit("[["), F.coalesce(c, F.lit("")), F.lit("]]"))
    quoted = [front_line("name", F.col("name")), front_line("city", link("city")), front_line("category", link("category")), F.concat(F.lit("practice: "), F.coalesce("practice", F.lit(""))), front_line("phone", F.col("phone")), front_line("website", F.col("website")), front_line("address", F.col("address"))]
    head = F.concat_ws("\n", F.lit("---"), F.lit("type: business"), *quoted, F.concat(F.lit("status: "), F.coalesce("status", F.lit("prospect"))), front_line("source", link("source")), F.lit("---"))
    sections = F.concat_ws("\n\n", *[F.lit(f"## {s}") for s in ("Angle", "Research", "Contacts", "Call log")])
    return businesses.select("slug", F.concat_ws("\n\n", head, F.concat(F.lit("# "), F.col("name")), sections).alias("text"))


def replaced_section(text: Column, heading: str, body: Column) -> Column:
    """A note with one section's text replaced, or the section added at the end."""
    block = F.concat(F.lit(f"## {heading}\n"), body, F.lit("\n"))
    has = text.rlike(rf"(?m)^##\s+{heading}\s*$")
    before = F.regexp_extract(text, rf"(?ms)\A(.*?)^##\s+{heading}\s*$", 1)
    after = F.regexp_extract(text, rf"(?ms)^##\s+{heading}\s*$.*?(^##\s.*)\z", 1)
    return F.when(has, F.concat(before, block, F.when(after != "", F.concat(F.lit("\n"), after)).otherwise(""))).otherwise(F.concat(F.rtrim(text), F.lit("\n\n"), block))


def set_front(text: Column, key: str, value: Column) -> Column:
    """A note with one front matter key set, in its place or before the end of the front matter."""
    line = front_line(key, value)
    has = text.rlike(rf"(?m)^{key}:")
    before, after = F.regexp_extract(text, rf"(?ms)\A(.*?)^{key}:[^\n]*", 1), F.regexp_extract(text, rf"(?ms)^{key}:[^\n]*(.*)\z", 1)
    parts = F.split(text, "---", 3)
    put = F.concat(F.lit("---"), F.rtrim(parts[1]), F.lit("\n"), line, F.lit("\n---"), parts[2])
    return F.when(has, F.concat(before, line, after)).when(text.startswith("---") & (F.size(parts) == 3), put).otherwise(text)


def preview(text: Column, words: int = 400) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " ")


def site_digest(records: DataFrame) -> DataFrame:
    """Markdown of each page record."""
    heads = F.array_join(F.transform("headings", lambda h: F.concat(F.lit("- "), h)), "\n")
    return records.select("url", F.concat_ws("\n\n", F.concat(F.lit("## "), F.coalesce(filled("title"), "url")), filled("meta_description"), filled(heads), preview(F.col("full_text"))).alias("markdown"))


def archive_digest(stats: DataFrame, openers: DataFrame, archive: str) -> DataFrame:
    """Markdown of each archive: counts, lengths, repeated beginnings."""
    o = openers.groupBy(archive).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "opener", "n"))).alias("_o"))
    lines = F.array_join(F.transform("_o", lambda x: F.concat(F.lit("- "), x["opener"], F.lit(" ("), x["n"], F.lit(")"))), "\n")
    head = F.concat(F.lit("# "), F.col(archive), F.lit("\n\nposts: "), F.col("n"), F.lit(", median: "), F.col("median_chars"), F.lit(", mean: "), F.col("mean_chars"))
    return stats.join(o, archive, "left").select(archive, F.concat_ws("\n\n", head, lines).alias("markdown"))
