"""Contacts from landed pages: schema markup, addresses with what stands near them, and pages about one person."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import html as H
from gleanery.functions.json import schema_people
from gleanery.functions.text import clean_email, email_domain, email_local, filled, is_person_name, is_personal_email, is_role_inbox, name_fits_email, name_of_email, phone, stripped_tags, title_case
from gleanery.functions.urls import crawl_key, host, normalized, path, registrable, same_site
from gleanery.operators.dedup import first_wins
from gleanery.operators.filters import is_careers_page
from gleanery.operators.ranking import BIO_PATH, OWNER_TITLES

# Fixed values.
NEAR_TITLES = r"(?i)\b(Esq\.?|Partner|Founder|Founding\s+Partner|Managing\s+Attorney|Managing\s+Partner|Principal|President|Shareholder|Attorney\s+at\s+Law|Of\s+Counsel|Associate|Counsel)\b"
NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+)+)"
NUMBER = r"\+?1?[-.\s(]*\d{3}[-.\s)]*\d{3}[-.\s]*\d{4}"
RADIUS, BIO_RADIUS, TITLE_RADIUS = 160, 280, 300
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("email", T.StringType()), T.StructField("near", T.StringType())])))
def windows(text: pd.Series, radius: pd.Series) -> pd.Series:
    """Each address of a text once, with the text around its first place. Needs offsets, which patterns in Spark don't give."""

    def of(t, r):
        found = {}
        for m in _EMAIL.finditer(t or ""):
            found.setdefault(m[1].lower(), (t[max(0, m.start() - r) : m.end() + r]))
        return [{"email": e, "near": w} for e, w in found.items()]

    return pd.Series([of(t, r) for t, r in zip(text, radius, strict=True)], index=text.index)


def _columns(df: DataFrame, **columns) -> DataFrame:
    none, no = F.lit(None).cast("string"), F.lit(False)
    text = {c: columns.get(c, none) for c in ("name", "title", "email", "phone", "profile_url")}
    flags = {c: F.coalesce(columns.get(c, no), no) for c in ("schema_person", "from_attorney_bio", "from_careers_privacy", "from_linkedin")}
    return df.select("slug", *[filled(x).alias(c) for c, x in text.items()], F.array("url").alias("source_pages"), F.array(F.lit("website")).alias("sources"), *[x.alias(c) for c, x in flags.items()], "ord")


def from_schema(pages: DataFrame) -> DataFrame:
    """People in JSON-LD of pages (slug, firm, site, url, html, ord), their addresses if they are the firm's own."""
    p = pages.select("slug", "firm", "site", "url", "ord", F.posexplode(schema_people("html")).alias("_i", "p"))
    mail = clean_email("p.email")
    own = F.when(same_site(email_domain(mail), "site"), mail)
    p = p.withColumn("ord", F.col("ord") * 10_000 + F.col("_i")).where(is_person_name("p.name", "firm"))
    link = F.coalesce(filled("p.url"), "url")
    return _columns(p, name=F.col("p.name"), title=F.col("p.title"), email=own, phone=phone("p.phone"), profile_url=link, schema_person=F.lit(True), from_attorney_bio=link.rlike(BIO_PATH))


def from_patterns(pages: DataFrame) -> DataFrame:
    """Addresses of the firm's own domain with a name that fits them nearby, a title and a number."""
    text = stripped_tags("html")
    bio = path("url").rlike(BIO_PATH)
    p = pages.select("slug", "firm", "site", "url", "ord", bio.alias("_bio"), F.posexplode(windows(text, F.when(bio, BIO_RADIUS).otherwise(RADIUS))).alias("_i", "w"))
    p = p.withColumns({"_mail": clean_email("w.email"), "ord": F.col("ord") * 10_000 + 5_000 + F.col("_i")}).where(F.col("_mail").isNotNull() & same_site(email_domain("_mail"), "site"))
    names = F.filter(F.regexp_extract_all("w.near", F.lit(NAME), 1), lambda n: is_person_name(n, F.col("firm")))
    p = p.withColumn("_names", names)
    fitting = F.try_element_at(F.filter("_names", lambda n: name_fits_email(n, F.col("_mail"))), F.lit(1))
    first = F.when(F.col("_bio") & ~is_role_inbox("_mail"), F.try_element_at("_names", F.lit(1)))
    derived = F.when(~F.col("_bio") & is_personal_email("_mail"), name_of_email(email_local("_mail")))
    p = p.withColumn("_name", F.coalesce(fitting, first, derived))
    title = F.when(F.col("_name").isNotNull() | F.col("_bio"), F.coalesce(filled(F.regexp_extract("w.near", OWNER_TITLES, 0)), filled(F.regexp_extract("w.near", NEAR_TITLES, 0))))
    return _columns(p, name=F.col("_name"), title=title, email=F.col("_mail"), phone=phone(F.regexp_extract("w.near", NUMBER, 0)), profile_url=F.col("url"), from_attorney_bio=F.col("_bio"), from_careers_privacy=is_careers_page("url"))


def from_bios(pages: DataFrame) -> DataFrame:
    """Pages about one person: the subject by the address, heading or title, with the page's number."""
    b = pages.where(path("url").rlike(BIO_PATH))
    last = F.regexp_extract(path("url"), r"/([^/]+)/?$", 1)
    by_path = title_case(F.regexp_replace(F.regexp_replace(last, r"\.[a-z]+$", ""), "[-_]+", " "))
    pick = lambda x: F.when(is_person_name(x, F.col("firm")), x)
    heading = F.try_element_at(H.h1s("html"), F.lit(1))
    lead = F.trim(F.regexp_extract(H.title("html"), r"^([^|–-]+)", 1))
    b = b.withColumns({"_name": F.coalesce(pick(heading), pick(lead), pick(by_path)), "_phone": F.try_element_at(H.phones("html", fax=False), F.lit(1)), "ord": F.col("ord") * 10_000 + 9_000})
    return _columns(b.where("_name is not null and _phone is not null"), name=F.col("_name"), phone=F.col("_phone"), profile_url=F.col("url"), from_attorney_bio=F.lit(True))


def extracted(pages: DataFrame) -> DataFrame:
    """All contacts of landed pages (slug, firm, site, url, html, ord), in the order of pages and places."""
    return from_schema(pages).unionByName(from_patterns(pages)).unionByName(from_bios(pages))


def bio_links(pages: DataFrame, each: bool = False) -> DataFrame:
    """Links of pages to pages about people of the same site, each once: the second wave to look at. each: once for every page, with its url and a rank."""
    links = pages.select("slug", "site", "url", "ord", F.posexplode(H.hrefs("html")).alias("_i", "_h")).withColumn("link", normalized("_h", "url"))
    good = links.where((registrable(host("link")) == F.col("site")) & path("link").rlike(BIO_PATH)).withColumn("_key", crawl_key("link"))
    if each:
        return good.select("slug", "url", "link", F.struct((~path("link").rlike(BIO_PATH)).alias("other"), "link").alias("rank"))
    return first_wins(good, ["slug", "_key"], ["ord", "_i"]).select("slug", "link")


def with_board(contacts: DataFrame, results: DataFrame) -> DataFrame:
    """Contacts with those that board results (slug, linkedin_company, contacts) name; masked ones are left out."""
    from gleanery.operators.filters import is_masked

    c = results.select("slug", "linkedin_company", F.posexplode("contacts").alias("ord", "c")).where(~is_masked("c.name"))
    base = c.select(
        "slug", filled("c.name").alias("name"), filled("c.title").alias("title"), F.lower(filled("c.email")).alias("email"), F.lit(None).cast("string").alias("phone"), filled("c.profile_url").alias("profile_url"),
        F.array(F.coalesce("linkedin_company", F.lit(""))).alias("source_pages"), F.array(F.lit("linkedin")).alias("sources"), F.lit(False).alias("schema_person"), F.lit(False).alias("from_attorney_bio"), F.lit(False).alias("from_careers_privacy"), F.lit(True).alias("from_linkedin"),
        (F.col("ord") + F.lit(2**40)).cast("long").alias("ord"),
    )
    return contacts.withColumn("ord", F.col("ord").cast("long")).unionByName(base)


def filled_phones(contacts: DataFrame, found: DataFrame) -> DataFrame:
    """Contacts without a number with the one found for their name (slug, name, phone)."""
    f = found.select("slug", F.lower("name").alias("_n"), F.col("phone").alias("_p")).dropDuplicates(["slug", "_n"])
    j = contacts.join(f, (contacts.slug == f.slug) & (F.lower("name") == F.col("_n")), "left").drop(f.slug)
    return j.withColumn("phone", F.coalesce(filled("phone"), "_p")).drop("_n", "_p")
