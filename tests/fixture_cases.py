"""Operators applied to the invented fixtures, with the rows expected of them, worked out by hand from the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions.json import schema_people, schema_types
from gleanery.operators import contacts as C
from gleanery.operators import entities, pages, ranking
from gleanery.plans import fixtures, prep
from gleanery.sources import directories
from gleanery.streaming import archive

CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], str]] = {}


def query(columns: str, values: str):
    def add(f):
        CASES[f.__name__] = f, f"SELECT * FROM (VALUES {values}) AS t({columns})"
        return f

    return add


@query(
    "firm, source, phone, city",
    """('Bluebonnet Roofing Co', 'Comptroller', '', 'Austin'), ('Lone Pine Roofing Supply', 'Comptroller', '', 'Waco'), ('State Farm Agency', 'Comptroller', '', 'Dallas'), ('Pecan Realty LLC', 'TREC', '', 'Travis'),
    ('Cool Air Heating', 'TDLR', '+1-512-555-0100', 'Round Rock'), ('Cedar Dental', 'OpenStreetMap', '+1-512-555-0111', 'O''Neil-Park'), ('Mesa Clinic', 'OpenStreetMap', '', 'Texas'), ('Hill Family Clinic', 'NPPES', '+1-512-555-0122', 'Austin'),
    ('O''Hara & Vale', 'Justia', '+1-512-555-0133', 'Austin'), ('Vale Trial Group', 'FindLaw', '+1-512-555-0144', 'Round Rock')""",
)
def directory_candidates(spark: SparkSession) -> DataFrame:
    return directories.parsed(fixtures.payloads(spark), "roofing").select("firm", "source", "phone", "city")


@query("firm, reason", "('Lone Pine Roofing Supply', 'supply_not_contractor'), ('State Farm Agency', 'junk_name')")
def candidate_rejects(spark: SparkSession) -> DataFrame:
    return entities.screened(directories.parsed(fixtures.payloads(spark), "roofing"), "roofing")[1].select("firm", "reason")


@query(
    "slug, change",
    """('acme-law', 'same'), ('birch', 'same'), ('bluebonnet', 'updated'), ('vale', 'updated'), ('lawn', 'same'), ('pecan-realty-llc', 'created'), ('cool-air-heating', 'created'), ('cedar-dental', 'created'), ('mesa-clinic', 'created'),
    ('hill-family-clinic', 'created'), ('o-hara-vale', 'created')""",
)
def directory_ingest(spark: SparkSession) -> DataFrame:
    return prep.ingest(fixtures.payloads(spark), fixtures.businesses(spark), "roofing")[0].select("slug", "change")


@query("slug, name, email, score", "('f', 'dana vale', 'dana.vale@f.example', 15), ('f', NULL, 'info@f.example', -3), ('f', 'jordan kim', 'jordan.kim@f.example', 6), ('f', 'lee park', NULL, 6), ('g', NULL, 'office@g.example', -3)")
def contact_merge(spark: SparkSession) -> DataFrame:
    return entities.merged_contacts(fixtures.contacts(spark)).select("slug", F.lower("name").alias("name"), "email", F.col("poc_score").cast("int").alias("score"))


@query("slug, email", "('f', 'dana.vale@f.example')")
def contact_shortlist(spark: SparkSession) -> DataFrame:
    return ranking.shortlist(ranking.best_contact(entities.merged_contacts(fixtures.contacts(spark)))).select("slug", "email")


@query("slug, email, n_pages", "('f', 'info@f.example', 2), ('g', 'office@g.example', 1)")
def inbox_fallback(spark: SparkSession) -> DataFrame:
    return ranking.inbox_fallback(entities.merged_contacts(fixtures.contacts(spark))).select("slug", "email", F.size("pages").alias("n_pages"))


@query("place, kind, value", "(0, 'type', 'LegalService'), (1, 'type', 'Person'), (2, 'type', 'Review'), (0, 'person', 'Dana Vale'), (0, 'phone', '+1-512-555-0152'), (1, 'phone', '+1-512-555-0150'), (2, 'phone', '+1-512-555-0151')")
def page_markup(spark: SparkSession) -> DataFrame:
    p = fixtures.pages(spark).where("ord = 0")
    part = lambda kind, column: p.select(F.posexplode(column).alias("place", "value")).select("place", F.lit(kind).alias("kind"), "value")
    return part("type", schema_types("html")).union(part("person", F.transform(schema_people("html"), lambda x: x["name"]))).union(part("phone", H.phones("html")))


@query("slug, link", "('vale', 'https://vale.example/attorneys/lee-park')")
def bio_links(spark: SparkSession) -> DataFrame:
    return C.bio_links(fixtures.pages(spark).selectExpr("'vale' as slug", "'vale.example' as site", "url", "html", "ord"))


@query("bot, signal", "('GPTBot', 'disallow-/ with allows'), ('ClaudeBot', 'disallow-/ with allows'), ('Google-Extended', 'allow-rules (1)'), ('PerplexityBot', 'allow-rules (1)')")
def robot_signals(spark: SparkSession) -> DataFrame:
    robots = spark.createDataFrame([("a.example", "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /\n\nUser-agent: *\nAllow: /x")], "site string, body string")
    return pages.robot_rules(robots, list(H.AI_BOTS)).select("bot", "signal")


@query("archive_id, id, favorite_count, first_seq", "('a', '1', 9, 0), ('a', '2', 1, 0), ('a', '3', 0, 2), ('a', '9', 0, 4), ('b', '1', 0, 0), ('d', '5', 0, 0), ('e', '6', 0, 0)")
def archive_posts(spark: SparkSession) -> DataFrame:
    return archive.archived(fixtures.payload_pages(spark)).select("archive_id", "id", "favorite_count", "first_seq")


@query("archive_id, stop, seq", "('a', 'exhausted', 3), ('b', 'rate_limited', 2), ('c', 'exhausted', 0), ('d', 'rate_limited', 0), ('e', 'fail', 1)")
def archive_stops(spark: SparkSession) -> DataFrame:
    return archive.stopped(fixtures.payload_pages(spark)).select("archive_id", "stop", "seq")


@query("slug, name", "('vale', 'Dana Vale')")
def weekly_preparation(spark: SparkSession) -> DataFrame:
    limits = spark.createDataFrame([("Law", True, 1, 0.5, None)], "category string, specialty_required boolean, min_notes int, min_site_fill double, specialty_mode string")
    return prep.prepare(fixtures.businesses(spark), fixtures.pages(spark), limits, "Law").shortlist.select("slug", "name")
