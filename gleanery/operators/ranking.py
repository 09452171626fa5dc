"""Scores, best contacts, shortlists and other orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import area_code, email_local, filled, is_personal_email, is_person_name, is_role_inbox, personal_email_bonus
from gleanery.functions.urls import is_priority, path

# Fixed values.
FIRST_TITLES = r"(?i)\b(owner|founder|founding\s+partner|managing\s+partner|managing\s+attorney|co-?founder)\b"
SECOND_TITLES = r"(?i)\b(partner|principal|president|shareholder)\b"
OWNER_TITLES = r"(?i)\b(owner|founder|founding\s+partner|managing\s+partner|managing\s+attorney|partner|principal|president|shareholder|co-?founder|of\s+counsel|senior\s+partner|name\s+partner)\b"
FOUNDER_TITLES = r"(?i)\b(founder|founding|owner|managing)\b"
BIO_PATH = r"(?i)/(attorney|attorneys|lawyer|lawyers|team|our-team|people|staff|bio|bios|professionals?|our-attorneys)/[^/]+/?$|/(attorney-profile|attorney-bio|lawyer-profile)/?$"


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, place: str = "place") -> DataFrame:
    """The first n rows of each key, with their place."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def contact_score() -> Column:
    """The additive score of a contact row."""
    named, title, email = is_person_name("name"), F.coalesce("title", F.lit("")), filled("email")
    bio = _yes(F.col("from_attorney_bio")) | _yes(F.col("profile_url").rlike(BIO_PATH))
    points = [
        F.when(named, 5).otherwise(0),
        F.when(title.rlike(FIRST_TITLES), 4).when(title.rlike(SECOND_TITLES), 3).otherwise(0),
        F.when(email.isNotNull() & (is_personal_email("email") | (personal_email_bonus("email") >= 2)), 3).otherwise(0),
        F.when(filled("phone").isNotNull(), 2).otherwise(0),
        F.when(bio, 1).otherwise(0),
        F.when(_yes(F.col("from_linkedin")) & named, 1).otherwise(0),
        F.when(email.isNotNull() & is_role_inbox("email"), -3).otherwise(0),
        F.when(_yes(F.col("from_careers_privacy")), -2).otherwise(0),
    ]
    return sum(points[1:], points[0])


def simple_score() -> Column:
    """The other, plainer score that parts of the reference use."""
    title = F.coalesce("title", F.lit(""))
    return F.when(filled("name").isNotNull(), 5).otherwise(0) + F.when(title.rlike(OWNER_TITLES), 4).otherwise(0) + F.when(filled("email").isNotNull(), 3).otherwise(0) + F.when(filled("phone").isNotNull(), 2).otherwise(0)


def contact_order() -> list[Column]:
    """Best first. Needs kind and poc_score."""
    email, title = filled("email"), F.coalesce("title", F.lit(""))
    role = email.isNotNull() & is_role_inbox("email")
    person = F.col("kind") == "person"
    return [
        F.desc(person),
        F.desc(person & email.isNotNull() & ~role),
        F.desc(email.isNotNull() & ~role & is_personal_email("email")),
        F.desc(title.rlike(FOUNDER_TITLES)),
        F.desc("poc_score"),
        F.desc(title.rlike(OWNER_TITLES)),
        F.desc(email.isNotNull() & ~role),
        F.desc(filled("phone").isNotNull()),
    ]


def best_contact(contacts: DataFrame, key: str = "slug", ord_: str = "ord") -> DataFrame:
    """One contact of each firm: a person with an address of their own if there is one, else a person, else the first inbox."""
    scored = contacts.where(filled("email").isNotNull() | is_person_name("name")).withColumn("poc_score", contact_score())
    return top(scored, [key], [*contact_order(), F.asc(ord_)]).drop("place")


def inbox_fallback(contacts: DataFrame, key: str = "slug", ord_: str = "ord") -> DataFrame:
    """Per firm the role inbox seen on most pages, else the first address."""
    some = contacts.where(filled("email").isNotNull()).withColumns({"_role": is_role_inbox("email"), "_pages": F.size("source_pages")})
    order = [F.desc("_role"), F.desc(F.when(F.col("_role"), F.col("_pages")).otherwise(0)), F.asc(ord_)]
    return top(some, [key], order).select(key, F.lower("email").alias("email"), F.array_sort("source_pages").alias("pages"))


def shortlist(best: DataFrame, key: str = "slug") -> DataFrame:
    """Firms whose best contact is a person that can be written to, best first."""
    two_part = email_local("email").rlike(r"^[a-z]+[._-][a-z]+$")
    fine = (F.col("kind") == "person") & filled("email").isNotNull() & ~is_role_inbox("email") & (two_part | is_person_name("name"))
    return best.where(fine).orderBy(F.desc("poc_score"), F.asc(key))


def prioritized(urls: DataFrame, site: str, most: int, home_first: bool = True) -> DataFrame:
    """Per site the addresses to look at first: home, then wanted paths, then short ones."""
    p = path("url")
    class_ = F.when(is_priority("url"), 0).otherwise(1)
    if home_first:
        class_ = F.when(p == "/", -1).otherwise(class_)
    return top(urls, [site], [class_.asc(), F.length(p).asc(), F.lower("url").asc(), F.asc("url")], max(1, most))


def key_pages(pages: DataFrame, key: str, labels: list[tuple[str, str]], ord_: str = "ord") -> DataFrame:
    """The first good page of each label. labels: (label, pattern of the path), in order."""
    which = F.coalesce(*[F.when(path("url").rlike(pattern), F.lit(i)) for i, (_, pattern) in enumerate(labels)])
    found = pages.where("status = 'ok'").withColumn("_label", which).where("_label is not null")
    best = found.groupBy(key, "_label").agg(F.min_by(F.struct("url", "title"), ord_).alias("page"))
    name = F.element_at(F.array(*[F.lit(x) for x, _ in labels]), F.col("_label") + 1)
    return best.select(key, F.col("_label").alias("place"), name.alias("label"), "page.url", "page.title")


def firm_phone(phones: DataFrame, local: list[str], key: str = "slug", ord_: str = "ord") -> DataFrame:
    """Per firm the number to call: of local ones if there are any, one from a contact page first."""
    near = area_code("phone").isin(local) if local else F.lit(False)
    order = [F.desc(near), F.desc("contactish"), F.asc(ord_)]
    return top(phones.where(filled("phone").isNotNull()), [key], order).select(key, "phone", "source_url")


def poc_phone(phones: DataFrame, local: list[str] | None = None, key: str = "slug", ord_: str = "ord") -> DataFrame:
    """Per firm the number of the contact: from their own page first, else from a page that names them; local ones first."""
    near = area_code("phone").isin(local) if local else F.lit(False)
    order = [F.desc(F.col("is_bio") & F.col("mentions_poc")), F.desc(near), F.asc(ord_)]
    return top(phones.where(filled("phone").isNotNull() & F.col("mentions_poc")), [key], order).select(key, "phone", "source_url")


def timeline_page(hits: DataFrame, preferred: list[str], archive: str = "archive_id", ord_: str = "ord") -> DataFrame:
    """Of the captured pages of an archive the one to begin with: the last good one of the most wanted operation."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col("operation")), F.lit(0))
    good = hits.where("status = 200").withColumn("_rank", F.when(rank == 0, len(preferred) + 1).otherwise(rank))
    return top(good, [archive], [F.asc("_rank"), F.desc(ord_)]).drop("_rank", "place")
