"""Counts, scorecards, verdicts, themes and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.html import THEME_STOP_WORDS
from gleanery.functions.text import filled, opener, website_value

PI_PRACTICES = ("personal-injury", "pi", "trial")
PI_NAMES = "(?i)personal injury|injury law|trial attorney|trial lawyers|trial law"


def in_practice(df: DataFrame, practice: str):
    """Whether a business belongs to a practice: by alias, by substring, or (for personal injury) by name."""
    value = F.lower(F.coalesce(F.col("practice"), F.lit("")))
    if practice.lower() in PI_PRACTICES:
        named = F.coalesce(F.col("name").rlike(PI_NAMES), F.lit(False)) if "name" in df.columns else F.lit(False)
        return value.isin(*PI_PRACTICES) | value.contains("personal-injury") | named
    return value.contains(practice.lower())


def scorecard(businesses: DataFrame, practice: str | None = None) -> DataFrame:
    """Per category: how many businesses there are and how many have a phone, a site and an e-mail; the same for a practice."""
    phone, site, email = filled("phone").isNotNull(), website_value("website").isNotNull(), filled("email").isNotNull()
    part = in_practice(businesses, practice) if practice else F.lit(False)
    counts = businesses.groupBy("category").agg(
        F.count("*").alias("notes"),
        F.count_if(phone).alias("with_phone"),
        F.count_if(site).alias("with_website"),
        F.count_if(email).alias("with_email"),
        F.count_if(part).alias("practice_notes"),
        F.count_if(part & site).alias("practice_with_website"),
        F.count_if(part & phone).alias("practice_with_phone"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns({"site_fill": ratio(F.col("with_website"), F.col("notes")), "practice_site_fill": ratio(F.col("practice_with_website"), F.col("practice_notes"))})


def verdicts(scores: DataFrame, thresholds: DataFrame, practice: bool = False) -> DataFrame:
    """Per category: COVERED or not, why not, and what to run next. Thresholds are one row a category."""
    t = thresholds.select(F.lower("category").alias("_key"), *[c for c in thresholds.columns if c != "category"])
    j = scores.join(t, F.lower("category") == F.col("_key"), "left")
    n, fill, least_n, least_fill = F.col("notes"), F.round("site_fill", 6), F.col("min_notes"), F.col("min_site_fill")
    if practice:
        special = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0)), d) if c in j.columns else d
        n, fill = F.col("practice_notes"), F.round("practice_site_fill", 6)
        least_n, least_fill = special("specialty_min_notes", least_n), special("specialty_min_site_fill", least_fill)
    missing = F.col("_key").isNull()
    few, empty = n < F.coalesce(least_n, F.lit(0)), fill < F.coalesce(least_fill, F.lit(0.0))
    special_mode = F.coalesce(filled("specialty_mode"), F.lit("specialty-directory"))
    return j.select(
        "category",
        F.when(~missing & ~few & ~empty, "COVERED").otherwise("NOT COVERED").alias("verdict"),
        F.when(missing, "no matrix row").otherwise(F.concat_ws("; ", F.when(few, "notes"), F.when(empty, "site_fill"))).alias("reasons"),
        F.when(missing, "coverage-check").when(few, F.when(F.col("specialty_required"), special_mode).otherwise("bulk-dump")).when(empty, "enrich").otherwise("").alias("next_mode"),
    )


def theme_hints(pages: DataFrame, site: str, most: int = 25, alone: int = 15) -> DataFrame:
    """Per site: frequent words of the titles and headings of good pages; those seen once only where nothing is seen twice. Ties by word."""
    text = F.lower(F.concat_ws(" ", "title", F.array_join("h1s", " ")))
    words = pages.where("status = 'ok'").select(site, F.explode(F.regexp_extract_all(text, F.lit(r"([a-z][a-z0-9\-]{2,})"), 1)).alias("token"))
    counts = words.where(~F.col("token").isin(THEME_STOP_WORDS)).groupBy(site, "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy(site).orderBy(F.desc("n"), "token")
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    best = F.max("n").over(Window.partitionBy(site))
    keep = F.when(best >= 2, F.col("n") >= 2).otherwise(F.col("place") <= alone)
    return ranked.withColumn("_keep", keep).where("_keep").select(site, "token", "n", F.col("place").cast("long").alias("place"))


def outcome_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages by outcome, and all of them."""
    status = F.coalesce(filled("status"), F.lit("error"))
    return pages.groupBy(*keys).agg(*[F.count_if(status == s).alias(s) for s in ("ok", "timeout", "http_error", "error")], F.count("*").alias("total"))


def openers(posts: DataFrame, archive: str, most: int = 8) -> DataFrame:
    """Per archive: the beginnings that several posts share, of the most frequent ones."""
    counts = posts.select(archive, opener("text").alias("opener")).where("opener <> ''").groupBy(archive, "opener").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(archive).orderBy(F.desc("n"), "opener"))
    return counts.withColumn("_p", place).where((F.col("_p") <= most) & (F.col("n") > 1)).drop("_p")


def digest(posts: DataFrame, archive: str) -> DataFrame:
    """Per archive: number of posts that aren't blank, and the median and mean of their characters, cut to whole numbers."""
    length = F.length("text").cast("long")
    return posts.where(filled("text").isNotNull()).groupBy(archive).agg(
        F.count("*").alias("n"), F.floor(F.median(length)).cast("long").alias("median_chars"), F.floor(F.sum(length) / F.count("*")).cast("long").alias("mean_chars")
    )


def samples(posts: DataFrame, archive: str, order: list[str], n: int = 5) -> DataFrame:
    """The first posts of each archive."""
    return posts.withColumn("place", F.row_number().over(Window.partitionBy(archive).orderBy(*order))).where(F.col("place") <= n)


def multimap(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Key to its distinct values in order: e-mails to pages and the like."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(out))


def schema_types(pages: DataFrame, site: str, most: int = 20) -> DataFrame:
    """Per site: schema types by number of pages."""
    counts = pages.select(site, F.explode("schema_types").alias("type")).groupBy(site, "type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(site).orderBy(F.desc("n"), "type"))).where(F.col("place") <= most)


def request_counts(entries: DataFrame, most: int = 40) -> DataFrame:
    """Requests by method and path, the most frequent first."""
    return entries.groupBy("method", "path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method", "path").limit(most)


def large_responses(entries: DataFrame, most: int = 80) -> DataFrame:
    """Captured responses by size."""
    return entries.orderBy(F.desc("bytes"), "template", "method").limit(most)


def operation_counts(hits: DataFrame) -> DataFrame:
    """Per operation: how often it was captured, and the first capture as sample."""
    sample = F.struct(*[c for c in hits.columns if c not in ("operation", "ord")])
    return hits.groupBy("operation").agg(F.count("*").alias("n"), F.min_by(sample, "ord").alias("sample")).orderBy(F.desc("n"), "operation")


def fill_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows there are and how many have each column: before and after an enrichment."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(filled(c).isNotNull()).alias(f"with_{c}") for c in columns])


def detail_counts(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Per firm: jobs by detail status; all closed means that hiring is unknown, never "no"."""
    closed = F.col("listing_status") == "closed"
    return jobs.groupBy(*keys).agg(
        F.count("*").alias("jobs"), F.count_if(filled("description").isNotNull()).alias("descriptions"), F.count_if(closed).alias("closed"), F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("detail_status"), F.lit(1))))).alias("seen"),
        F.when(F.every(F.coalesce(closed, F.lit(False))), "unknown").otherwise("hiring").alias("status"),
    )


def exit_code(pages: DataFrame) -> DataFrame:
    """0 if any page is good, else 2."""
    return pages.agg(F.when(F.count_if(F.col("status") == "ok") > 0, 0).otherwise(2).alias("exit_code"))
