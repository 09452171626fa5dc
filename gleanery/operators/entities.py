"""Candidates and businesses: rejecting, deduplicating, matching, inserting; and the merge of contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import address_forms, company_key, email_local, filled, first_filled, is_person_name, is_personal_email, is_role_inbox, name_forms, name_of_email, phone, slug
from gleanery.functions.urls import is_directory
from gleanery.operators.dedup import first_wins
from gleanery.operators.filters import reject_reason
from gleanery.operators.ranking import BIO_PATH, contact_score
from gleanery.sources.tables import cut

# Verticals and what businesses of each are filed as.
VERTICALS = {
    "pi": ("Law", "personal-injury", "Justia"), "accounting": ("Accounting", None, "Comptroller"), "dentist": ("Dentist", None, "OpenStreetMap"),
    "insurance": ("Insurance", None, "OpenStreetMap"), "real-estate": ("Real estate", None, "TREC"), "hvac": ("HVAC", None, "TDLR"),
    "roofing": ("Roofing", None, "Comptroller"), "medical": ("Medical", None, "OpenStreetMap"), "engineering": ("Engineering", None, "Comptroller"),
    "family": ("Law", "family", "Justia"), "immigration": ("Law", "immigration", "Justia"),
}

#: Characters of the runs by which names that contain another are found, and of the shortest wanted name.
GRAM = 5


def screened(candidates: DataFrame, vertical: str = "") -> tuple[DataFrame, DataFrame]:
    """Candidates that stay, without directories as sites, and those that don't, with reason."""
    marked = candidates.withColumn("reason", reject_reason("firm", "phone", "address", vertical))
    site = F.when(~is_directory("candidate_website"), filled("candidate_website"))
    return marked.where("reason is null").drop("reason").withColumn("candidate_website", site), marked.where("reason is not null")


def unique_candidates(candidates: DataFrame, ord_: str = "ord", limit: int = 0) -> DataFrame:
    """The first candidate of each firm and phone over all recipes; a limit counts after that."""
    out = first_wins(candidates, [F.lower(F.trim("firm")), F.coalesce(phone("phone"), F.lit(""))], [ord_])
    return out.orderBy(ord_).limit(limit) if limit else out


def _runs(c: str, size: int) -> Column:
    """The distinct runs of so many characters in a name."""
    every = F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(F.col(c), i, size))
    return F.array_distinct(F.when(F.length(c) >= size, every).otherwise(F.array().cast("array<string>")))


def containing(short: DataFrame, long: DataFrame, part: str, whole: str) -> DataFrame:
    """Pairs of distinct names part (of GRAM characters or more) and whole that have the rarest run of part in common.

    Whatever contains part has all of its runs, so one of them is enough to find it. The one is that which
    the fewest wholes have; where a run occurs in no whole, nothing contains the part. Only candidates:
    the caller tests them. A beginning or ending that all names share costs nothing.

    Runs are compared as 32-bit hashes, so a count and a run are one number, whose minimum needs a hash table of
    parts and no sort of their runs. The joins keep counts and rarest runs, a row for each run and part, in hash tables:
    what streams by is all runs of all names, of which one that all names share comes to one task.
    """
    runs = lambda df, c: df.select(c, F.explode(_runs(c, GRAM)).alias("_run")).select(c, F.hash("_run").cast("long").bitwiseAND(F.lit(2**32 - 1)).alias("_gram"))
    of_long = runs(long, whole)
    counts = of_long.groupBy("_gram").agg(F.count("*").alias("_gram_count"))
    of_short = runs(short, part).join(counts.hint("shuffle_hash"), "_gram", "left")
    numbered = F.shiftleft(F.least(F.coalesce("_gram_count", F.lit(0)), F.lit(2**31 - 1)).cast("long"), 32).bitwiseOR(F.col("_gram"))
    rarest = of_short.groupBy(part).agg(F.min(numbered).alias("_rare")).where(F.col("_rare") >= 2**32)
    rarest = rarest.select(part, F.col("_rare").bitwiseAND(F.lit(2**32 - 1)).alias("_gram"))
    return of_long.join(rarest.hint("shuffle_hash"), "_gram").select(part, whole)


def contained_match(wanted: DataFrame, known: DataFrame, key: str, name_key: str, keys: list[str], ord_: str = "ord") -> DataFrame:
    """Per wanted row the first known row whose name contains its own, or is contained in it.

    Substrings may begin inside words. Names are reduced to distinct ones first. Wanted names have GRAM
    characters or more, so they, and known ones as long, are found by their rarest runs; shorter known names
    are equal to a run of their length.
    """
    w = wanted.select(key).where(F.length(key) >= GRAM).distinct()
    n = known.groupBy(name_key).agg(F.min(ord_).alias(ord_)).where(F.col(name_key) != "")
    up = containing(w, n, key, name_key).where(F.contains(F.col(name_key), F.col(key)))
    down = containing(n.where(F.length(name_key) >= GRAM), w, name_key, key).where(F.contains(F.col(key), F.col(name_key)))
    pieces = F.explode(F.concat(*[_runs(key, size) for size in range(1, GRAM)])).alias(name_key)
    few = w.select(key, pieces).join(n.where(F.length(name_key) < GRAM).select(name_key), name_key)
    pairs = reduce(DataFrame.unionByName, [x.select(key, name_key) for x in (up, down, few)])
    first = pairs.join(n, name_key).groupBy(key).agg(F.min(ord_).alias(ord_))
    return wanted.join(first, key).select(*keys, key, ord_)


def matched(candidates: DataFrame, businesses: DataFrame, ord_: str = "ord") -> DataFrame:
    """Candidates with the slug of the business they are, or null.

    In order: equal phone with a fitting name, equal name, a name that contains the other.
    """
    b = businesses.select("slug", company_key("name").alias("_bn"), phone("phone").alias("_bp"))
    c = candidates.withColumns({"_n": company_key("firm"), "_p": phone("phone")})
    by_phone = b.where("_bp is not null").groupBy("_bp").agg(F.min_by(F.struct("slug", "_bn"), "slug").alias("p"))
    by_name = b.where("_bn <> ''").groupBy("_bn").agg(F.min("slug").alias("_name_slug"))
    j = c.join(by_phone, F.col("_p") == F.col("_bp"), "left").join(by_name, F.col("_n") == by_name["_bn"], "left")
    fits = (F.col("_n") == F.col("p._bn")) | F.contains("p._bn", "_n") | F.contains("_n", "p._bn")
    j = j.withColumn("slug", F.coalesce(F.when(fits, F.col("p.slug")), "_name_slug"))
    part = contained_match(c.select(ord_, "_n"), b.select(F.col("slug").alias("_ps"), "_bn"), "_n", "_bn", [ord_], "_ps").select(F.col(ord_).alias("_o"), "_ps")
    return j.join(part, F.col(ord_) == F.col("_o"), "left").withColumn("slug", F.coalesce("slug", "_ps")).select(*candidates.columns, "slug")


def _numbered(c: str) -> tuple[Column, Column]:
    """A slug's parts where it is another one with a number behind it, of 2 or more as slugs are numbered; else nulls."""
    number = F.regexp_extract(c, r"^.*-([1-9]\d{0,17})$", 1)
    n = F.when(number != "", number.cast("long"))
    return F.when(n >= 2, F.regexp_replace(c, r"-\d+$", "")), F.when(n >= 2, n)


def _ranked(rows: DataFrame, base: str, order: list[str], counts: Column) -> DataFrame:
    """rows with _rank: how many rows of the same base, up to and with this one, count. A base may hold any share of all rows.

    Rows are dealt by ranges of base and order and written as they were dealt; a range counts its own, and
    each base's counts of the ranges before are added. So a base that fills many ranges is many groups.
    """
    dealt = cut(rows.repartitionByRange(base, *order).withColumns({"_range": F.spark_partition_id(), "_one": counts.cast("long")}))
    sums = dealt.groupBy(base, "_range").agg(F.sum("_one").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(base).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(base).alias("_b"), F.col("_range").alias("_r"), before.alias("_before"))
    # Rows that don't count come first among equals, so they see what is really before them.
    own = F.sum("_one").over(Window.partitionBy(base, "_range").orderBy(*order, "_one").rowsBetween(Window.unboundedPreceding, 0))
    at = dealt.withColumn("_own", own).join(sums, F.col(base).eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r")))
    return at.withColumn("_rank", F.col("_own") + F.col("_before")).drop("_range", "_one", "_own", "_b", "_r", "_before")


#: Ranks that are matched with free numbers at once.
STRETCH = 4096


def unique_slugs(rows: DataFrame, base: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """rows with unique_slug: in order, the first of base, base-2, base-3, ... that neither an earlier row has nor taken (slug).

    The k-th row of a base gets its k-th free number. Numbers that are taken cut the numbers into stretches in
    which rank and number differ by a constant, so rows meet stretches, not numbers. "acme" and "acme-2" can
    want the same slug: it is the one's that comes to it first. Of acme's rows before the first row of
    "acme-2", more must be there than free numbers below 2; so every number that is also a base is won or
    lost by counts, base after base, and bases that are numbers of numbers ("acme-2-3") a round later.
    Equal orders count in any order; null bases stay null.
    """
    columns, rows = rows.columns, cut(rows)
    firsts = rows.where(F.col(base).isNotNull()).groupBy(F.col(base).alias("_slug")).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = cut(firsts.withColumns(dict(zip(("_parent", "_n"), _numbered("_slug"), strict=True))))
    names = firsts.select(F.col("_slug").alias("_parent"))
    if taken is None:
        taken = rows.sparkSession.createDataFrame([], "slug string")
    old = taken.select("slug").where("slug is not null").distinct()
    parent, number = _numbered("slug")
    used = old.select(F.explode(F.array(F.struct(F.col("slug").alias("_owner"), F.lit(1).cast("long").alias("_n")), F.struct(parent.alias("_owner"), number.alias("_n")))).alias("u")).select("u.*")
    used = cut(used.where("_owner is not null").join(names, F.col("_owner") == F.col("_parent"), "left_semi"))
    # Numbers that are bases as well, and free when all begins.
    rivals = firsts.where("_parent is not null").join(names, "_parent", "left_semi").join(old, F.col("_slug") == F.col("slug"), "left_anti")
    rivals = cut(rivals.select(F.col("_parent").alias("_owner"), "_n", "_slug", "_first"))
    marks = rivals.select(F.col("_owner").alias(base), *[F.col(f"_first.{c}").alias(c) for c in order], F.col("_n").alias("_mark"))
    marked = _ranked(rows.withColumn("_mark", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True), base, order, F.col("_mark").isNull())
    ranked = cut(marked)
    before = ranked.where("_mark is not null").select(F.col(base).alias("_owner"), F.col("_mark").alias("_n"), F.col("_rank").alias("_come"))
    # What is below each rival's number: taken numbers, and rivals, in the order of numbers.
    lines = used.select("_owner", "_n", F.lit(1).alias("_taken"), F.lit(None).cast("long").alias("_come"), F.lit(None).cast("string").alias("_slug"))
    lines = lines.unionByName(rivals.join(before, ["_owner", "_n"]).select("_owner", "_n", F.lit(0).alias("_taken"), "_come", "_slug"))
    below = Window.partitionBy("_owner").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("_n") - 1 - F.coalesce(F.sum("_taken").over(below), F.lit(0)) - F.coalesce(F.sum(1 - F.col("_taken")).over(below), F.lit(0))
    open_ = cut(lines.withColumn("_free", free).where("_taken = 0").select("_owner", "_n", "_slug", (F.col("_come") - F.col("_free")).alias("_lead")))
    lost = names.where("false").select(F.col("_parent").alias("_owner"))
    depth = rivals.agg(F.max(F.size(F.regexp_extract_all("_slug", F.lit(r"-\d+"), 0)))).first()[0] or 0
    won = None
    for _ in range(depth):
        # A base whose own name is lost has one free number less. Numbers it can't come to even so are left out of the fold.
        led = open_.join(lost.withColumn("_less", F.lit(1)), "_owner", "left").withColumn("_lead", F.col("_lead") + F.coalesce("_less", F.lit(0)))
        each = led.where("_lead > 0").groupBy("_owner").agg(F.array_sort(F.collect_list(F.struct("_n", "_lead", "_slug"))).alias("a"))
        fold = F.aggregate("a", F.struct(F.lit(0).cast("long").alias("w"), F.array().cast("array<struct<_n:bigint,_slug:string>>").alias("won")), lambda s, x: F.when(x["_lead"] > s["w"], F.struct((s["w"] + 1).alias("w"), F.concat(s["won"], F.array(F.struct(x["_n"].alias("_n"), x["_slug"].alias("_slug")))).alias("won"))).otherwise(s), lambda s: s["won"])
        won = cut(each.select("_owner", F.explode(fold).alias("x")).select("_owner", "x.*"))
        lost = won.select(F.col("_slug").alias("_owner"))
    gone = used.unionByName(lost.select("_owner", F.lit(1).cast("long").alias("_n")))
    if won is not None:
        gone = gone.unionByName(open_.join(won, ["_owner", "_n"], "left_anti").select("_owner", "_n"))
    # Stretches between numbers that are gone: ranks from _low to _high have the number rank + _add.
    at = Window.partitionBy("_owner").orderBy("_n")
    most = ranked.where(f"_mark is null and `{base}` is not null").groupBy(F.col(base).alias("_owner")).agg(F.max("_rank").alias("_most"))
    cuts = gone.distinct().unionByName(names.select(F.col("_parent").alias("_owner"), F.lit(0).cast("long").alias("_n")))
    cuts = cuts.select("_owner", (F.row_number().over(at) - 1).cast("long").alias("_add"), "_n", F.lead("_n").over(at).alias("_next")).join(most, "_owner")
    high = F.least(F.coalesce(F.col("_next") - 1 - F.col("_add"), F.col("_most")), F.col("_most"))
    stretches = cuts.select("_owner", "_add", (F.col("_n") - F.col("_add") + 1).alias("_low"), high.alias("_high")).where("_low <= _high")
    part = lambda x: F.floor(F.col(x) / F.lit(STRETCH))
    stretches = stretches.withColumn("_part", F.explode(F.sequence(part("_low"), part("_high"))))
    numbered = ranked.where("_mark is null").withColumn("_at", part("_rank"))
    on = (F.col(base) == F.col("_owner")) & (F.col("_at") == F.col("_part")) & F.col("_rank").between(F.col("_low"), F.col("_high"))
    n = F.col("_rank") + F.col("_add")
    name = F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string")))
    return numbered.join(stretches, on, "left").select(*columns, name.alias("unique_slug"))


def upserted(candidates: DataFrame, businesses: DataFrame, vertical: str, ord_: str = "ord", default_city: str = "Texas") -> DataFrame:
    """businesses after an ingest: known ones get what they lack, others are new. change tells which: created, updated or same."""
    category, practice, label = VERTICALS[vertical]
    m = cut(matched(candidates, businesses, ord_))
    hits = m.where("slug is not null").groupBy("slug").agg(
        F.min_by(F.when(filled("phone").isNotNull(), F.coalesce(phone("phone"), "phone")), F.when(filled("phone").isNotNull(), F.col(ord_))).alias("c_phone"),
        F.min_by("address", F.when(filled("address").isNotNull(), F.col(ord_))).alias("c_address"),
        F.min_by("candidate_website", F.when(filled("candidate_website").isNotNull() & (F.col("source") == "OpenStreetMap"), F.col(ord_))).alias("c_website"),
        F.array_sort(F.collect_set(F.when(F.col("source") != "OpenStreetMap", filled("candidate_website")))).alias("c_sites"),
    )
    b = businesses.join(hits, "slug", "left")
    none = F.lit(None).cast("string")
    new_site = F.when(~is_directory("c_website"), F.col("c_website"))
    got = {"phone": first_filled("phone", "c_phone"), "address": first_filled("address", "c_address"), "website": first_filled("website", new_site)}
    got["practice"] = first_filled("practice", F.when(F.col("c_sites").isNotNull(), F.lit(practice))) if practice else filled("practice")
    changed = F.lit(False)
    for c, x in got.items():
        changed |= ~filled(c).eqNullSafe(x)
    sites = F.coalesce("c_sites", F.array().cast("array<string>"))
    old = b.select("slug", "name", "city", "category", *[x.alias(c) for c, x in got.items()], *["status", "source"], sites.alias("candidate_websites"), F.when(changed, "updated").otherwise("same").alias("change"))
    fresh = first_wins(m.where("slug is null"), [company_key("firm")], [ord_])
    site = F.when((F.col("source") == "OpenStreetMap") & ~is_directory("candidate_website"), F.col("candidate_website"))
    fresh = unique_slugs(fresh.withColumn("_base", slug("firm")), "_base", [ord_], businesses.select("slug"))
    new = fresh.select(
        F.col("unique_slug").alias("slug"), F.col("firm").alias("name"), first_filled("city", F.lit(default_city)).alias("city"), F.lit(category).alias("category"), phone("phone").alias("phone"), filled("address").alias("address"), site.alias("website"),
        (F.lit(practice) if practice else none).alias("practice"), F.when(phone("phone").isNotNull(), "call-ready").otherwise("prospect").alias("status"), first_filled("source", F.lit(label)).alias("source"),
        F.filter(F.array(F.when(F.col("source") != "OpenStreetMap", filled("candidate_website"))), lambda x: x.isNotNull()).alias("candidate_websites"), F.lit("created").alias("change"),
    )
    return old.unionByName(new)


CONTACT = ["name", "title", "email", "phone", "profile_url", "source_pages", "sources", "schema_person", "from_attorney_bio", "from_careers_privacy", "from_linkedin"]


def _merged_contacts(c: DataFrame, keys: list[Column | str], ord_: str) -> DataFrame:
    """Contacts of one key as one, the first setting what later ones may only better."""
    person = is_person_name("name")
    role = is_role_inbox("email")
    bio = F.coalesce(F.col("profile_url").rlike(BIO_PATH), F.lit(False))
    o = F.col(ord_)
    none = F.array().cast("array<string>")
    pick = lambda c, rank: F.min_by(c, F.when(filled(c).isNotNull(), F.struct(rank, o)))
    return c.groupBy(*keys).agg(
        pick("name", (~person).alias("r")).alias("name"),
        F.min_by("title", F.when(filled("title").isNotNull(), F.struct(-F.length("title"), o))).alias("title"),
        pick("email", role.alias("r")).alias("email"),
        pick("phone", F.lit(0).alias("r")).alias("phone"),
        F.min_by("profile_url", F.when(filled("profile_url").isNotNull(), F.struct(F.when(bio, -o).otherwise(o).alias("r")))).alias("profile_url"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("source_pages", none))))).alias("source_pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", none))))).alias("sources"),
        *[F.max(F.coalesce(x, F.lit(False))).alias(x) for x in ("schema_person", "from_attorney_bio", "from_careers_privacy", "from_linkedin")],
        F.min(o).alias(ord_),
    )


def merged_contacts(contacts: DataFrame, key: str = "slug", ord_: str = "ord", initials: bool = False) -> DataFrame:
    """Contacts of each firm merged by name, personal address or inbox.

    People keep their identity though they share a role inbox; an address of its own joins the first
    person whose name it fits; shared inboxes also stand for themselves. Adds kind and poc_score.
    """
    person, role, own = is_person_name("name"), is_role_inbox("email") & filled("email").isNotNull(), is_personal_email("email")
    group = F.when(person, F.concat(F.lit("name:"), F.lower("name"))).when(own, F.concat(F.lit("email:"), F.lower("email"))).when(role, F.concat(F.lit("inbox:"), F.lower("email"))).otherwise(F.concat(F.lit("orphan:"), F.col(ord_).cast("string")))
    c = contacts.withColumn("_g", group).withColumn("name", F.when(role & ~person, F.lit(None)).otherwise(F.col("name")))
    once = _merged_contacts(c, [key, "_g"], ord_)
    people = once.where("_g like 'name:%'")
    mails = once.where("_g like 'email:%'")
    # An index of the forms of address that a name can have, with the first person of each, so an address meets a few rows whatever the firm's size.
    index = people.select(key, "_g", ord_, F.explode(F.array_compact(F.concat(name_forms("name"), F.array(F.concat(F.lit("@"), F.lower("email")))))).alias("_form"))
    index = index.groupBy(F.col(key).alias("_k"), "_form").agg(F.min_by("_g", ord_).alias("_to"), F.min(ord_).alias("_first"))
    asked = mails.select(F.col(key).alias("_k"), F.col("_g").alias("_mg"), F.explode(F.array_compact(F.concat(address_forms("email"), F.array(F.concat(F.lit("@"), F.lower("email")))))).alias("_form"))
    to = asked.join(index, ["_k", "_form"]).groupBy("_k", "_mg").agg(F.min_by("_to", "_first").alias("_to"))
    moved = once.join(to, (F.col(key) == F.col("_k")) & (F.col("_g") == F.col("_mg")), "left").withColumn("_g", F.coalesce("_to", "_g")).drop("_k", "_mg", "_to")
    shared = people.where(is_role_inbox("email") & filled("email").isNotNull()).select(
        key, F.concat(F.lit("inbox:"), F.lower("email")).alias("_g"), *[F.col(x) if x in ("email", "source_pages") else F.lit(None).cast(people.schema[x].dataType).alias(x) for x in CONTACT], ord_
    )
    out = _merged_contacts(moved.unionByName(shared), [key, "_g"], ord_).drop("_g")
    named = F.coalesce(filled("name"), F.when(is_personal_email("email"), name_of_email(email_local("email"), initials)))
    out = out.withColumn("name", named)
    kind = F.when(is_person_name("name") | (is_personal_email("email") & filled("name").isNotNull()), "person").otherwise("inbox")
    linkedin, website = F.array_contains("sources", "linkedin"), F.array_contains("sources", "website")
    source = F.when(linkedin & website, "website+linkedin").when(linkedin | (F.col("from_linkedin") & ~website), "linkedin").otherwise(F.coalesce(F.try_element_at("sources", F.lit(1)), F.lit("website")))
    return out.withColumn("kind", kind).withColumn("poc_score", contact_score()).withColumn("source", source)


def website_matches(businesses: DataFrame, candidates: DataFrame, pages: DataFrame, key: str = "slug") -> DataFrame:
    """Businesses without a site with the first candidate address that a landed page confirms.

    candidates: slug, url, ord; pages: url, final_url, http_code, text. Confirmed: not a directory, an
    answer below 400, enough words of the firm's name on it, and no redirect to a directory.
    """
    from gleanery.functions.urls import origin
    from gleanery.operators.filters import firm_tokens, mentions_firm

    lacking = businesses.where(filled("website").isNull()).select(key, firm_tokens("name").alias("_tokens"))
    c = candidates.where(~is_directory("url")).join(lacking, key)
    seen = c.join(pages.select("url", "final_url", "http_code", "text"), "url")
    good = seen.where((F.col("http_code") < 400) & ~is_directory("final_url") & mentions_firm("text", "_tokens", strict=True))
    return good.groupBy(key).agg(F.min_by(origin("final_url"), "ord").alias("website"))


def queue(businesses: DataFrame, profiles: DataFrame, key: str = "slug") -> DataFrame:
    """Businesses with what their profile knows where they lack it: the candidates of the people and jobs stage."""
    p = profiles.select(F.col(key).alias("_k"), F.col("website").alias("p_website"), F.col("linkedin_company").alias("p_board"))
    return businesses.join(p, F.col(key) == F.col("_k"), "left").select(key, "name", first_filled("website", "p_website").alias("website"), first_filled("linkedin_company", "p_board").alias("linkedin_company"))
