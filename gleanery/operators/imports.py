"""Imports of result rows: which note they belong to, contacts in one shape, board states, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import clean_email, filled, first_filled, is_person_name, phone, squeezed
from gleanery.functions.urls import is_directory
from gleanery.operators.filters import is_masked, validated
from gleanery.streaming.archive import exploded

OPERATIONS = ("UserTweets", "UserTweetsAndReplies", "UserOriginalsTimeline")
# Titles of owners as imports see them; the flags of the tabs of a post search.
OWNERS = r"(?i)\b(owner|founder|co-?founder|ceo|president|managing\s+partner|principal)\b"
TABS = {"top": "", "latest": "live", "people": "user", "media": "image"}


def with_notes(rows: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (slug, path) with the note (slug, path) they name, and those that name none, with why.

    A path counts by the name of its file and has to agree with the slug; a slug is a plain name.
    """
    stem = F.regexp_replace(F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]+)$", 1), r"\.md$", "")
    own = F.regexp_replace(filled("slug"), r"\.md$", "")
    bad = F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)"), "path leaves the folder").when(filled(stem).isNotNull() & own.isNotNull() & (stem != own), "path and slug differ").when(own.rlike("[/\\\\]"), "slug is no plain name").when(first_filled(own, stem).isNull(), "no slug")
    r = rows.withColumn("_slug", first_filled(own, stem)).withColumn("error", bad)
    n = notes.select(F.col("slug").alias("_n")).distinct()
    j = r.join(n, F.col("_slug") == F.col("_n"), "left").withColumn("error", F.coalesce("error", F.when(F.col("_n").isNull(), "note not found"))).withColumn("slug", F.col("_slug")).drop("_slug", "_n")
    return j.where("error is null").drop("error"), j.where("error is not null")


def one_contact(c: Column, fields: list[str]) -> Column:
    """A contact in one shape, whatever its source calls photo and address. fields: those it has."""
    get = lambda *names: F.coalesce(squeezed(first_filled(*[c[n] for n in names if n in fields])), F.lit("")) if any(n in fields for n in names) else F.lit("")
    return F.struct(get("name").alias("name"), get("title").alias("title"), get("email").alias("email"), get("location").alias("location"), get("photo_url", "pfp").alias("photo_url"), get("profile_url", "url").alias("profile_url"))


def owner(contacts: Column, explicit: Column) -> Column:
    """The owner stated, else the first contact with an owner's title."""
    titled = F.filter(contacts, lambda c: filled(c["name"]).isNotNull() & F.coalesce(c["title"].rlike(OWNERS), F.lit(False)))
    return F.coalesce(squeezed(filled(explicit)), F.try_element_at(titled, F.lit(1))["name"])


def board_states(results: DataFrame) -> DataFrame:
    """Per slug of results (slug, linkedin_company, contacts, owner): how many people are named or masked, and the state of the link."""
    named = F.size(F.filter("contacts", lambda c: ~is_masked(c["name"]) & is_person_name(c["name"]))) + F.when(is_person_name("owner"), 1).otherwise(0)
    masked = F.size(F.filter("contacts", lambda c: is_masked(c["name"])))
    n, m = F.greatest(named, F.lit(0)), F.greatest(masked, F.lit(0))
    status = F.when(n > 0, "linked").when(m > 0, "names_masked").when(filled("linkedin_company").isNotNull(), "linked_no_people").otherwise("not_linked_yet")
    return results.select("slug", filled("linkedin_company").alias("company_url"), status.alias("status"), n.alias("contacts_named"), m.alias("contacts_masked"))


def board_contacts(results: DataFrame) -> DataFrame:
    """Contacts of board results: people by name, the owner stated, and of masked people those whose title or address is known."""
    c = results.select("slug", "linkedin_company", "owner", F.posexplode("contacts").alias("ord", "c"))
    masked, name = is_masked("c.name"), squeezed("c.name")
    people = c.where(F.when(masked, filled("c.title").isNotNull() | filled("c.email").isNotNull()).otherwise(is_person_name(name)))
    none, no = F.lit(None).cast("string"), F.lit(False)
    source = F.array_distinct(F.filter(F.array(filled("linkedin_company"), F.when(~masked, filled("c.profile_url"))), lambda x: x.isNotNull()))
    flags = [no.alias(x) for x in ("schema_person", "from_attorney_bio", "from_careers_privacy")] + [F.lit(True).alias("from_linkedin")]
    rows = people.select("slug", F.when(~masked, name).alias("name"), filled("c.title").alias("title"), clean_email("c.email").alias("email"), none.alias("phone"), first_filled("c.profile_url", "linkedin_company").alias("profile_url"), source.alias("source_pages"), F.array(F.lit("linkedin")).alias("sources"), *flags, F.col("ord").cast("long").alias("ord"))
    owners = results.where(is_person_name("owner")).select("slug", squeezed("owner").alias("name"), F.lit("Owner").alias("title"), none.alias("email"), none.alias("phone"), none.alias("profile_url"), F.filter(F.array(filled("linkedin_company")), lambda x: x.isNotNull()).alias("source_pages"), F.array(F.lit("linkedin")).alias("sources"), *flags, F.lit(2**30).cast("long").alias("ord"))
    return rows.unionByName(owners)


def applied(rows: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that can be applied, errors with reasons, and counts of both. A bad row never stops the others."""
    checked = validated(rows)
    wrong = checked.where(F.size("errors") > 0).withColumn("error", F.concat_ws("; ", "errors")).drop("errors")
    good, lost = with_notes(checked.where(F.size("errors") == 0).drop("errors"), notes)
    errors = wrong.select("slug", "error").union(lost.select("slug", "error"))
    stats = good.select(F.lit("applied").alias("outcome")).union(errors.select(F.lit("error"))).groupBy("outcome").agg(F.count("*").alias("n"))
    return good, errors, stats


def candidate_urls(text: Column) -> Column:
    """Addresses in a note that may be the firm's site: those marked so first, then any that aren't a directory's; each once."""
    tidy = lambda u: F.regexp_replace(u, r"[).,;]+$", "")
    marked = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)candidate_website:\s*(https?://\S+)"), 1), tidy)
    others = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"""(https?://[^\s<>"']+)"""), 1), tidy), lambda u: ~is_directory(u) & ~F.lower(u).rlike("justia|findlaw|schema\\.org"))
    return F.array_distinct(F.concat(marked, others))


def search_url(query: Column, tab: str = "latest") -> Column:
    """The address of a post search."""
    flag = TABS.get(tab, "")
    return F.concat(F.lit("https://x.com/search?q="), F.regexp_replace(F.url_encode(query), r"\+", "%20"), F.lit("&src=typed_query" + (f"&f={flag}" if flag else "")))


def request_template(requests: DataFrame) -> DataFrame:
    """Captured requests (url, method, headers, body) as templates: operation, address, variables without cursor, names of headers only."""
    from gleanery.functions.urls import operation, query_value, template

    json_of = lambda k: F.expr(f"try_parse_json(coalesce(_{k}, get_json_object(body, '$.{k}')))")
    r = requests.withColumns({f"_{k}": query_value("url", k) for k in ("variables", "features", "fieldToggles")})
    variables = F.map_filter(F.from_json(F.coalesce("_variables", F.get_json_object("body", "$.variables")), "map<string,string>"), lambda k, _: k != "cursor")
    return r.select(
        operation("url")["operation"].alias("operation"), F.coalesce(filled(operation("url")["query_id"]), F.get_json_object("body", "$.queryId")).alias("query_id"), F.upper(F.coalesce(filled("method"), F.lit("GET"))).alias("method"), template("url").alias("template"),
        variables.alias("variables"), json_of("features").alias("features"), json_of("fieldToggles").alias("field_toggles"), F.array_sort(F.transform(F.map_keys("headers"), lambda h: F.lower(h))).alias("header_names"),
    ).where("operation is not null")


def next_request(templates: DataFrame) -> DataFrame:
    """template and cursor as the next page's request, as data: the variables with the cursor put in."""
    return templates.withColumn("variables", F.map_concat("variables", F.create_map(F.lit("cursor"), F.col("cursor"))))


def posts_of_hits(hits: DataFrame) -> DataFrame:
    """Posts in captured responses of timeline operations (archive_id, ord, operation, status, body), the first of each id."""
    good = hits.where(F.col("operation").isin(*OPERATIONS)).select("archive_id", F.col("ord").alias("seq"), F.lit(200).alias("status"), "body")
    p = exploded(good)
    rest = [c for c in p.columns if c not in ("archive_id", "id", "seq", "pos")]
    return p.groupBy("archive_id", "id").agg(F.min_by(F.struct(*rest), F.struct("seq", "pos")).alias("p")).select("archive_id", "id", "p.*")


def found_business(wanted: DataFrame, businesses: DataFrame) -> DataFrame:
    """Per wanted row (i, name, phone) the note it is: equal phone with a fitting name, else equal name, else equal phone."""
    from gleanery.functions.text import company_key

    w = wanted.select("i", company_key("name").alias("_w"), phone("phone").alias("_p"))
    b = businesses.select("slug", company_key("name").alias("_n"), phone("phone").alias("_q"))
    fits = (F.col("_n") == F.col("_w")) | ((F.col("_w") != "") & F.contains("_n", "_w")) | ((F.col("_n") != "") & F.contains("_w", "_n"))
    by_phone = w.join(b, F.col("_p") == F.col("_q")).select("i", "slug", F.when(fits, 0).otherwise(2).alias("_r"))
    by_name = w.where("_w <> ''").join(b, F.col("_n") == F.col("_w")).select("i", "slug", F.lit(1).alias("_r"))
    best = by_phone.union(by_name).groupBy("i").agg(F.min_by("slug", F.struct("_r", "slug")).alias("slug"))
    return wanted.join(best, "i", "left")
