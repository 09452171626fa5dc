"""The weekly preparation as one plan: businesses to a ranked shortlist, all firms at once.

registry payloads -> candidates -> businesses -> coverage and queue -> page records and e-mails ->
contacts -> merged contacts -> best contact -> shortlist. Stages exchange DataFrames keyed by slug;
nothing is overwritten, so no stage has to restore what another lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions.text import email_domain, filled
from gleanery.functions.urls import host, registrable, same_site
from gleanery.operators import contacts as C
from gleanery.operators import entities, filters, metrics, ranking
from gleanery.operators import pages as crawl
from gleanery.sources import directories

# What people call categories, and the vertical of a category and practice.
ALIASES = {
    "pi": ("Law", "personal-injury"), "personal-injury": ("Law", "personal-injury"), "personal injury": ("Law", "personal-injury"), "injury": ("Law", "personal-injury"), "trial": ("Law", "personal-injury"),
    "family": ("Law", "family"), "family-law": ("Law", "family"), "immigration": ("Law", "immigration"), "law": ("Law", None), "lawyer": ("Law", None), "lawyers": ("Law", None), "attorney": ("Law", None), "attorneys": ("Law", None),
    "trucking": ("Logistics", None), "truck": ("Logistics", None), "freight": ("Logistics", None), "logistics": ("Logistics", None), "oilfield": ("Oilfield", None), "oil": ("Oilfield", None), "oil-field": ("Oilfield", None),
    "hvac": ("HVAC", None), "ac": ("HVAC", None), "a/c": ("HVAC", None), "a-c": ("HVAC", None), "roofing": ("Roofing", None), "roof": ("Roofing", None), "dentist": ("Dentist", None), "dental": ("Dentist", None),
    "accounting": ("Accounting", None), "cpa": ("Accounting", None), "insurance": ("Insurance", None), "real-estate": ("Real estate", None), "real estate": ("Real estate", None), "realtor": ("Real estate", None), "realty": ("Real estate", None),
    "medical": ("Medical", None), "clinic": ("Medical", None), "doctor": ("Medical", None), "engineering": ("Engineering", None), "engineer": ("Engineering", None),
}
SPECIALTIES = {
    ("Law", "personal-injury"): "pi", ("Law", "pi"): "pi", ("Law", "trial"): "pi", ("Law", "family"): "family", ("Law", "immigration"): "immigration", ("Accounting", None): "accounting", ("Dentist", None): "dentist",
    ("Insurance", None): "insurance", ("Real estate", None): "real-estate", ("HVAC", None): "hvac", ("Roofing", None): "roofing", ("Medical", None): "medical", ("Engineering", None): "engineering",
}
KEY_PAGES = [("contact", r"(?i)/(contact|contact-us)/?$"), ("about", r"(?i)/(about|about-us|our-firm)/?$"), ("team", r"(?i)/(team|our-team|people|staff)/?$"), ("attorneys", r"(?i)/(attorneys|attorney|lawyers)/?$")]
BOILERPLATE = ("/wp-admin/", "/wp-includes/", "/cgi-bin/")


def resolve_alias(raw: str, practice: str | None = None) -> tuple[str, str | None]:
    """Category and practice that a word stands for; an explicit practice wins."""
    category, own = ALIASES.get(raw.strip().lower(), (raw.strip(), None))
    return category, practice or own


def specialty(category: str, practice: str | None) -> str | None:
    """The vertical to ingest; for law without a known practice that of personal injury."""
    return SPECIALTIES.get((category, practice)) or SPECIALTIES.get((category, None)) or ("pi" if category == "Law" else None)


def ingest(payloads: DataFrame, businesses: DataFrame, vertical: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """businesses after an ingest of payloads, and the rejects with reason: candidates, and payloads that no reader takes."""
    kept, rejects = entities.screened(directories.parsed(payloads, vertical), vertical)
    rejects = rejects.unionByName(directories.rejected(payloads), allowMissingColumns=True)
    return entities.upserted(entities.unique_candidates(kept, "ord", limit), businesses, vertical), rejects


def compacted_bots(bots: Column) -> Column:
    """Rules of bots (array of bot, signal, disallows) without boilerplate, six paths each."""
    worth = lambda b: F.filter(b["disallows"], lambda d: ~d.isin(*BOILERPLATE))
    keep = F.filter(bots, lambda b: ~(b["signal"].startswith("partial-disallow") & (F.size(worth(b)) == 0)))
    return F.array_sort(F.transform(keep, lambda b: F.struct(b["bot"].alias("bot"), b["signal"].alias("signal"), F.slice(worth(b), 1, 6).alias("disallows"))))


def profiles(firms: DataFrame, pages: DataFrame) -> DataFrame:
    """Firm profiles from firms (slug, name, website, category, practice, linkedin_company) and their landed pages (slug, url, html, status, ord)."""
    site = registrable(host("website"))
    p = pages.join(firms.select("slug", site.alias("site")), "slug")
    good = p.where("status = 'ok'")
    mails = good.select("slug", "url", "site", F.explode(H.emails_in("html")).alias("email")).where(same_site(email_domain("email"), "site"))
    email_pages = metrics.multimap(mails, ["slug", "email"], "url", "pages").groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("email", "pages"))).alias("emails"))
    themes = metrics.theme_hints(good.select("slug", "status", H.title("html").alias("title"), H.h1s("html").alias("h1s")), "slug")
    themes = themes.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("themes"))
    keys = ranking.key_pages(good.select("slug", "url", "status", "ord", H.title("html").alias("title")), "slug", KEY_PAGES)
    keys = keys.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("place", "label", "url", "title"))).alias("key_pages"))
    crawl = metrics.outcome_counts(p, ["slug"]).select("slug", F.col("ok").alias("pages_ok"), F.col("total").alias("pages_fetched"))
    out = firms
    for part in (email_pages, themes, keys, crawl):
        out = out.join(part, "slug", "left")
    words = F.slice(F.coalesce("themes", F.array().cast("array<string>")), 1, 8)
    bits = F.array_join(F.slice(words, 1, 6), ", ")
    ok = F.coalesce("pages_ok", F.lit(0)).cast("string")
    name = F.concat(F.col("name"), F.lit(" ("), host("website"), F.lit(") — "), F.coalesce("category", F.lit("")))
    summary = F.when(bits != "", F.concat(name, F.lit(" site; crawl fetched "), ok, F.lit(" OK pages. Title/h1 theme signals: "), bits, F.lit("."))).otherwise(F.concat(name, F.lit(" site researched; "), ok, F.lit(" OK pages fetched.")))
    linked = F.when(filled("linkedin_company").isNotNull(), "linked").otherwise("not_linked_yet")
    return out.withColumns({"themes": words, "summary": summary, "linkedin_status": linked})


@dataclass
class Prepared:
    coverage: DataFrame
    queue: DataFrame
    profiles: DataFrame
    contacts: DataFrame
    best: DataFrame
    inboxes: DataFrame
    shortlist: DataFrame
    #: What is kept in memory and on disk until release().
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Let go of what the stages share, once they are read."""
        for df in self.held:
            df.unpersist()


def prepare(businesses: DataFrame, pages: DataFrame, thresholds: DataFrame, category: str, practice: str | None = None, results: DataFrame | None = None, max_firms: int = 0, max_pages: int = 25) -> Prepared:
    """All stages for one category. pages: url, html, status, ord of landed pages; they join firms by site.

    Contacts come from at most max_pages of a firm, in two waves: the common paths of its site, then pages about
    people that its good pages about the team link to. Profiles tell of all that landed.
    """
    coverage = metrics.verdicts(metrics.scorecard(businesses, practice), thresholds, practice is not None)
    chosen = filters.selected(businesses.where(filled("website").isNotNull()), category, practice, limit=max_firms)
    queue = chosen.select("slug", "name", "website", "category", "practice", "linkedin_company")
    sites = queue.select("slug", F.col("name").alias("firm"), registrable(host("website")).alias("site"))
    mine = pages.withColumn("_site", registrable(host("url"))).join(sites, F.col("_site") == F.col("site")).drop("_site")
    people = C.bio_links(mine.where((F.col("status") == "ok") & filters.is_people_page("url")), each=True)
    read = crawl.waves(crawl.seeds(queue), mine, people, max_pages).drop("wave", "place")
    found = C.extracted(read.where("status = 'ok'"))
    found = C.with_board(found, results) if results is not None else found
    # The merge reads its input several times; kept, it is extracted once and the plan stays small. A lost part is computed anew.
    found = found.persist()
    merged = entities.merged_contacts(found).persist()
    best = ranking.best_contact(merged)
    return Prepared(coverage, queue, profiles(queue, mine.select("slug", "url", "html", "status", "ord")), merged, best, ranking.inbox_fallback(merged), ranking.shortlist(best), (found, merged))


def merged_profile(profile: DataFrame, rows: DataFrame) -> DataFrame:
    """Profiles (slug, best_poc_score, best_poc_url) with an import's best contact where it is at least as good; and the board's address."""
    r = rows.select("slug", F.col("poc_score").alias("_s"), F.col("profile_url").alias("_u"), F.col("linkedin_company").alias("_c"))
    better = F.coalesce(F.col("_s") >= F.coalesce("best_poc_score", F.lit(-99)), F.lit(False))
    j = profile.join(r, "slug", "left")
    return j.withColumns({"best_poc_url": F.when(better, F.col("_u")).otherwise(F.col("best_poc_url")), "best_poc_score": F.when(better, F.col("_s")).otherwise(F.col("best_poc_score")), "linkedin_company": F.coalesce(filled("_c"), "linkedin_company")}).drop("_s", "_u", "_c")


def doctor(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table of an installation has: the health check."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = part if out is None else out.union(part)
    return out
