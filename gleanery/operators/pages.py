"""Site crawls over landed pages: links, records, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.html import LINKS, hrefs, page_record, robots_sitemaps, sitemap_locations
from gleanery.functions.urls import crawl_key, host, is_priority, normalized, origin, registrable
from gleanery.operators.dedup import first_wins
from gleanery.sources.tables import cut

COMMON_PATHS = ["", "/contact", "/contact-us", "/about", "/about-us", "/team", "/our-team", "/people", "/attorneys", "/staff", "/our-firm", "/attorneys-staff"]


def same_site_links(pages: DataFrame, key: str, most: int = LINKS) -> DataFrame:
    """Per page its first links within the site, each page once: key, place, link."""
    links = pages.select(key, F.col("url").alias("_base"), F.posexplode(hrefs("html")).alias("_pos", "_href"))
    links = links.withColumn("link", normalized("_href", "_base"))
    links = links.where(registrable(host("link")) == registrable(host("_base"))).withColumn("_key", crawl_key("link"))
    order = Window.partitionBy(key).orderBy("_pos")
    return first_wins(links, [key, "_key"], ["_pos"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(key, "place", "link")


def records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Landed pages (url, html, status) as page records with links and schema types."""
    from gleanery.functions.json import schema_types

    links = same_site_links(pages, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "link"))).alias("_l")).select(key, F.transform("_l", lambda x: x["link"]).alias("outbound_same_site_sample"))
    none = F.array().cast("array<string>")
    out = pages.select(key, "url", page_record("html", "url").alias("r"), schema_types("html").alias("schema_types")).select(key, "url", "r.*", "schema_types")
    return out.join(links, key, "left").withColumn("outbound_same_site_sample", F.coalesce("outbound_same_site_sample", none))


def seeds(firms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """slug, url, ord of the pages to start from: common paths of a firm's site, then pages known before; each once."""
    some = F.transform(F.array(*[F.lit(p) for p in COMMON_PATHS]), lambda p: F.concat(origin("website"), p, F.when(p == "", "/").otherwise("")))
    rows = firms.select("slug", F.posexplode(some).alias("ord", "url"))
    if known is not None:
        sites = firms.select("slug", registrable(host("website")).alias("_site"))
        more = known.join(sites, "slug").where(registrable(host("url")) == F.col("_site")).select("slug", (F.col("ord") + len(COMMON_PATHS)).alias("ord"), "url")
        rows = rows.unionByName(more)
    return first_wins(rows, ["slug", crawl_key("url")], ["ord"])


def frontier(start: DataFrame, robots: DataFrame, sitemaps: DataFrame, most_sitemaps: int = 25, large: int = 500) -> DataFrame:
    """site, url: pages that a site's sitemaps list, over landed files.

    start: site, url of sitemaps tried anyway; robots: site, body; sitemaps: url, body. Sitemaps of
    robots come first, nested ones in the order met, to any depth; a site has most_sitemaps in all,
    those that didn't land included. Sites with very many pages keep those on wanted paths.
    """
    listed = robots.select("site", F.posexplode(robots_sitemaps("body")).alias("_b", "url")).withColumn("_a", F.lit(0))
    tried = start.select("site", F.row_number().over(Window.partitionBy("site").orderBy("url")).alias("_b"), "url").withColumn("_a", F.lit(1))
    parsed = sitemaps.select(F.col("url").alias("_u"), sitemap_locations("body").alias("s"))
    met, seen, pages = listed.unionByName(tried), None, None
    while True:
        # One level: what is new, in the order met, as far as the site's number goes.
        first = met.groupBy("site", "url").agg(F.min(F.struct("_a", "_b")).alias("_at"))
        if seen is not None:
            before = seen.groupBy("site").agg(F.count("*").alias("_before"))
            first = first.join(seen, ["site", "url"], "left_anti").join(before, "site", "left")
        place = F.row_number().over(Window.partitionBy("site").orderBy("_at")) + (F.coalesce("_before", F.lit(0)) if seen is not None else F.lit(0))
        level = cut(first.withColumn("_place", place).where(F.col("_place") <= most_sitemaps).select("site", "url", "_place"))
        if level.isEmpty():
            break
        hit = cut(level.join(parsed, F.col("url") == F.col("_u")))
        found = hit.select("site", F.explode("s.pages").alias("url"))
        pages = found if pages is None else pages.union(found)
        met = hit.select("site", F.col("_place").alias("_a"), F.posexplode("s.nested").alias("_b", "url"))
        seen = level.select("site", "url") if seen is None else seen.union(level.select("site", "url"))
    if pages is None:
        return start.select("site", "url").where("false")
    unique = pages.where(registrable(host("url")) == F.col("site")).withColumn("url", normalized("url")).distinct()
    n = F.count("*").over(Window.partitionBy("site"))
    return unique.withColumn("_n", n).where((F.col("_n") <= large) | is_priority("url")).drop("_n")


def fetch_order(pages: DataFrame, key: str = "site", most: int = 60, ord_: str = "ord") -> DataFrame:
    """Landed pages as a crawl of a site would have met them: wanted paths first, then in the given order, each page once, at most so many a site. Adds place."""
    once = first_wins(pages.withColumn("_key", crawl_key("url")), [key, "_key"], [ord_])
    order = Window.partitionBy(key).orderBy(is_priority("url").desc(), ord_, "_key")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_key")


def waves(start: DataFrame, landed: DataFrame, links: DataFrame, most: int = 25, depth: int = 2) -> DataFrame:
    """The pages a crawl of each site fetches, wave after wave, within a budget of pages a site: landed rows with wave and place.

    start: slug, url, ord of the first wave. landed: slug, url and more; what isn't there has failed, but
    counts. links: slug, url (of the page they are on), link, rank; those of a wave's landed pages make the next
    wave, in order of rank and link, each page once. A wave joins only the links of the wave before.
    """
    key = crawl_key("url")
    begun = first_wins(start.withColumn("_key", key), ["slug", "_key"], ["ord"])
    order = Window.partitionBy("slug").orderBy("ord", "_key")
    fetched = cut(begun.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("slug", "_key", F.lit(1).alias("wave"), "place"))
    every, known = fetched, links.select("slug", key.alias("_from"), crawl_key("link").alias("_key"), "rank")
    here = landed.withColumn("_key", key)
    for wave in range(2, depth + 1):
        got = fetched.join(here.select("slug", "_key").distinct(), ["slug", "_key"]).select("slug", F.col("_key").alias("_from"))
        met = known.join(got, ["slug", "_from"]).groupBy("slug", "_key").agg(F.min("rank").alias("rank")).join(every, ["slug", "_key"], "left_anti")
        used = every.groupBy("slug").agg(F.max("place").alias("_used"))
        place = F.col("_used") + F.row_number().over(Window.partitionBy("slug").orderBy("rank", "_key"))
        fetched = cut(met.join(used, "slug").withColumn("place", place).where(F.col("place") <= most).select("slug", "_key", F.lit(wave).alias("wave"), "place"))
        if fetched.isEmpty():
            break
        every = every.unionByName(fetched)
    return here.join(every, ["slug", "_key"]).drop("_key")


def robot_rules(robots: DataFrame, bots: list[str], grouped: bool = True) -> DataFrame:
    """Per site and bot: its allow and disallow lines and what they amount to.

    grouped: lines of several agents in a row share the rules below; without it the last agent has them.
    """
    lines = robots.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> '' and line not like '#%'")
    field = F.lower(F.regexp_extract("line", r"^([A-Za-z-]+)\s*:", 1))
    lines = lines.select("site", "pos", field.alias("field"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("site").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    begins = is_agent & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent") if grouped else is_agent
    lines = lines.withColumn("group", F.sum(begins.cast("int")).over(w))
    agents = lines.where(is_agent).select("site", "group", F.lower("value").alias("agent")).distinct()
    rules = lines.where(~is_agent).join(agents, ["site", "group"])
    bot = F.explode(F.filter(F.array(*[F.lit(b) for b in bots]), lambda b: (F.lower(b) == F.col("agent")) | (F.col("agent") == "*")))
    rules = rules.select("site", "pos", "field", "value", bot.alias("bot"))
    listed = lambda f: F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == f) & (F.col("value") != ""), F.struct("pos", "value")))), lambda x: x["value"])
    got = rules.groupBy("site", "bot").agg(listed("allow").alias("allows"), listed("disallow").alias("disallows"))
    every = robots.select("site", F.explode(F.array(*[F.lit(b) for b in bots])).alias("bot")).join(got, ["site", "bot"], "left")
    none = F.array().cast("array<string>")
    allows, dis = F.coalesce("allows", none), F.coalesce("disallows", none)
    signal = (
        F.when(F.array_contains(dis, "/") & (F.size(allows) == 0), "disallow-all")
        .when(F.array_contains(dis, "/"), "disallow-/ with allows")
        .when(F.size(dis) > 0, F.concat(F.lit("partial-disallow ("), F.size(dis), F.lit(" rules)")))
        .when(F.size(allows) > 0, F.concat(F.lit("allow-rules ("), F.size(allows), F.lit(")")))
        .otherwise("no-specific-rules")
    )
    return every.select("site", "bot", signal.alias("signal"), F.slice(allows, 1, 8).alias("allows"), F.slice(dis, 1, 8).alias("disallows"))
