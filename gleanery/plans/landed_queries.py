"""Operators that need landed payloads, applied to payloads written from the driver's tables.

The driver's tables have no registries, board pages, notes or captures. Each of these queries
writes such payloads from whole tables (a customer becomes a permit, an order a job posting, an
event a post), has the operator read them, and returns what it finds. The SQL never sees the
payloads: it computes the same from the tables, so a fact lost or misread on the way shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions.json import schema_people, schema_types
from gleanery.operators import boards, contacts, entities, hiring, identity, imports, merge, pages, profiles, ranking
from gleanery.plans import prep
from gleanery.sources import archives, directories, documents, sinks
from gleanery.sources.tables import scratch, spread, table
from gleanery.streaming import archive, upserts, walks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def letters(x: str) -> Column:
    """Nine letters for a number, so that no name is inside another."""
    return F.expr(f"translate(lpad(cast({x} as string), 9, '0'), '0123456789', 'abcdefghij')")


def _sql_letters(x: str) -> str:
    return f"translate(lpad({x}::VARCHAR, 9, '0'), '0123456789', 'abcdefghij')"


def _tag(name: str, *inner, **attrs) -> Column:
    """An element as text."""
    head = [F.lit(f"<{name}")] + [p for k, v in attrs.items() for p in (F.lit(f' {k.strip("_").replace("_", "-")}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"'))]
    return F.concat(*head, F.lit(">"), *[x if isinstance(x, Column) else F.lit(x) for x in inner], F.lit(f"</{name}>"))


BOARD = "https://www.linkedin.com"


def _company(x: str) -> Column:
    return F.concat(F.lit(f"{BOARD}/company/co-"), F.col(x).cast("string"), F.lit("/"))


# Company pages: nations are companies, customers their people; those in debt are hidden.


@query(f"""
WITH p AS (SELECT c_nationkey AS k, c_custkey, c_acctbal < 0 AS hidden FROM customer),
n AS (SELECT k, count(*) FILTER (NOT hidden) AS named, count(*) FILTER (hidden) AS masked, min(c_custkey) FILTER (NOT hidden) AS first FROM p GROUP BY k)
SELECT n_nationkey AS company, CASE WHEN n_regionkey = 4 THEN 'company_mismatch' WHEN named > 0 THEN 'found' WHEN masked > 0 THEN 'names_masked' ELSE 'not_public' END AS status,
  CASE WHEN n_regionkey <> 4 THEN n_nationkey::VARCHAR END AS company_id, CASE WHEN n_regionkey = 4 THEN 0 ELSE coalesce(named, 0) END AS n_people,
  CASE WHEN n_regionkey = 4 THEN 0 ELSE coalesce(masked, 0) END AS masked, CASE WHEN n_regionkey <> 4 THEN 'Ann ' || {_sql_letters("first")} END AS first_name
FROM nation LEFT JOIN n ON k = n_nationkey""")
def board_company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("hidden", F.col("c_acctbal") < 0)
    name = F.when(F.col("hidden"), "LinkedIn Member").otherwise(F.concat(F.lit("Ann "), letters("c_custkey")))
    card = _tag("li", _tag("a", "", href=F.concat(F.lit("/in/p-"), F.col("c_custkey").cast("string"))), _tag("h3", name), _tag("h4", F.col("c_mktsegment")))
    cards = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("hidden", "c_custkey", card.alias("card")))).alias("cards"))
    n = table(spark, sf_dir, "nation").join(cards, F.col("n_nationkey") == F.col("k"), "left").withColumn("cards", F.coalesce("cards", F.array().cast(cards.schema["cards"].dataType)))
    n = spread(n)
    people = _tag("section", _tag("h2", "Employees at it"), F.array_join(F.transform("cards", lambda x: x["card"]), ""), data_test_id="employees-at")
    html = F.concat(F.lit('<link rel="canonical" href="'), _company("n_nationkey"), F.lit('">'), _tag("a", "See all jobs", href=F.concat(F.lit("/jobs/search?f_C="), F.col("n_nationkey").cast("string"))), people)
    asked = F.when(F.col("n_regionkey") == 4, f"{BOARD}/company/another/").otherwise(_company("n_nationkey"))
    got = boards.company_pages(n.select(F.col("n_nationkey").alias("key"), html.alias("html"), asked.alias("company")))
    return got.select(F.col("key").alias("company"), "status", "company_id", F.size("contacts").alias("n_people"), "masked", F.get("contacts", F.lit(0))["name"].alias("first_name"))


# Listings: customers are companies, their orders jobs; filled orders are closed, and one kind is another firm's.


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    return o.withColumns({"day": F.date_format("o_orderdate", "yyyy-MM-dd"), "other": F.col("o_orderpriority") == "5-LOW", "job": (F.col("o_orderkey") + 1_000_000).cast("string"), "jk": F.lower(F.lpad(F.hex("o_orderkey"), 16, "0"))})


@query("""
SELECT o_custkey AS firm, (o_orderkey + 1000000)::VARCHAR AS job_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date_posted
FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'""")
def board_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    employer = F.when(F.col("other"), f"{BOARD}/company/other/").otherwise(_company("o_custkey"))
    card = _tag("li", _tag("a", "x", href=F.concat(F.lit("/jobs/view/clerk-"), F.col("job"))), _tag("h3", F.col("o_orderpriority"), class_="base-search-card__title"), _tag("a", "Firm", href=employer), _tag("time", "then", datetime=F.col("day")), F.when(F.col("o_orderstatus") == "F", " No longer accepting applications").otherwise(""), class_="base-search-card")
    listing = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("html"))
    listing = listing.withColumns({"company": _company("o_custkey"), "company_id": F.col("o_custkey").cast("string")})
    jobs = boards.listed_jobs(listing).select("o_custkey", F.explode("jobs").alias("j"))
    return jobs.select(F.col("o_custkey").alias("firm"), "j.job_id", "j.title", "j.date_posted")


@query("""
SELECT (o_orderkey + 1000000)::VARCHAR AS job_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'job_mismatch' WHEN o_orderpriority = '5-LOW' THEN 'company_mismatch' ELSE 'ok' END AS detail_status,
  CASE WHEN detail_status = 'ok' THEN 'Work ' || o_custkey || chr(10) || chr(10) || '- ' || o_orderpriority END AS description,
  CASE WHEN detail_status = 'ok' THEN o_orderpriority END AS seniority_level, CASE WHEN detail_status = 'ok' THEN CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'observed' END END AS listing_status
FROM orders""")
def board_job_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    named = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("9"), F.col("job"))).otherwise(F.col("job"))
    employer = F.when(F.col("other"), f"{BOARD}/company/other/").otherwise(_company("o_custkey"))
    top = _tag("div", _tag("h1", "Clerk", class_="top-card-layout__title"), _tag("a", "Firm", class_="topcard__org-name-link", href=employer), F.when(F.col("o_orderstatus") == "F", _tag("span", "No longer accepting applications")).otherwise(""), class_="top-card-layout")
    text = _tag("div", _tag("div", _tag("p", F.concat(F.lit("Work "), F.col("o_custkey").cast("string"))), _tag("ul", _tag("li", F.col("o_orderpriority"))), class_="show-more-less-html__markup"), class_="description")
    level = _tag("li", _tag("h3", "Seniority level"), _tag("span", F.col("o_orderpriority"), class_="description__job-criteria-text"), class_="description__job-criteria-item")
    html = F.concat(F.lit(f'<link rel="canonical" href="{BOARD}/jobs/view/'), named, F.lit('/">'), top, text, level)
    p = o.select(F.col("job").alias("job_id"), html.alias("html"), _company("o_custkey").alias("company"), F.col("o_custkey").cast("string").alias("company_id"))
    return boards.job_details(p).select("job_id", "detail_status", "description", "seniority_level", "listing_status")


@query("""
SELECT o_custkey AS firm, lower(printf('%016x', o_orderkey)) AS job_id, o_orderpriority AS title, 'https://www.indeed.com/viewjob?jk=' || job_id AS url FROM orders WHERE o_orderpriority <> '5-LOW'""")
def second_board_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    name = F.when(F.col("other"), "Somebody Else").otherwise(F.concat(F.lit("Firm "), F.col("o_custkey").cast("string")))
    card = _tag("li", _tag("h2", _tag("a", F.col("o_orderpriority"), href=F.concat(F.lit("/viewjob?jk="), F.col("jk")))), _tag("span", name, data_testid="company-name"), data_jk=F.col("jk"))
    listing = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("html"))
    p = listing.withColumns({"url": F.lit("https://www.indeed.com/jobs?q=x"), "firm": F.concat(F.lit("FIRM "), F.col("o_custkey").cast("string")), "company": F.lit("")})
    return boards.second_listed_jobs(p).select("o_custkey", F.explode("jobs").alias("j")).select(F.col("o_custkey").alias("firm"), "j.job_id", "j.title", "j.url")


@query("""
SELECT lower(printf('%016x', o_orderkey)) AS job_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'job_mismatch' WHEN o_orderpriority = '5-LOW' THEN 'company_mismatch' ELSE 'ok' END AS detail_status,
  CASE WHEN detail_status = 'ok' THEN o_orderpriority END AS title, CASE WHEN detail_status = 'ok' THEN 'Work ' || o_custkey END AS description, CASE WHEN detail_status = 'ok' THEN 'base_salary' END AS pay_basis,
  CASE WHEN detail_status = 'ok' THEN CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'closed' ELSE 'observed' END END AS listing_status, CASE WHEN detail_status = 'ok' THEN 'https://apply.example/' || o_orderkey END AS apply_url
FROM orders""")
def second_board_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    named = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("f" * 16)).otherwise(F.col("jk"))
    schema = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("https://www.indeed.com/viewjob?jk="), F.col("jk")).alias("url"), F.col("day").alias("validThrough"), F.struct(F.col("o_totalprice").alias("value")).alias("baseSalary")))
    employer = F.concat(F.lit("https://www.indeed.com/cmp/"), F.when(F.col("other"), "other").otherwise(F.concat(F.lit("co-"), F.col("o_custkey").cast("string"))))
    html = F.concat(
        F.lit('<link rel="canonical" href="https://www.indeed.com/viewjob?jk='), named, F.lit('">'), _tag("h1", F.col("o_orderpriority"), class_="jobsearch-JobInfoHeader-title"), _tag("div", _tag("a", "Firm", href=employer), data_testid="inlineHeader-companyName"),
        _tag("div", _tag("p", F.concat(F.lit("Work "), F.col("o_custkey").cast("string"))), id="jobDescriptionText"), _tag("a", "Apply", id="applyButtonLink", href=F.concat(F.lit("https://apply.example/"), F.col("o_orderkey").cast("string"))), _tag("script", schema, type="application/ld+json"),
    )
    own = F.concat(F.lit("https://www.indeed.com/cmp/co-"), F.col("o_custkey").cast("string"))
    p = o.select(F.col("jk").alias("job_id"), html.alias("html"), F.lit("Firm").alias("firm"), own.alias("company"), F.lit("1997-01-01T00:00:00").alias("now"))
    return boards.second_job_details(p).select("job_id", "detail_status", "title", "description", "pay_basis", "listing_status", "apply_url")


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'https://apply.example/' || o_orderkey END AS apply_url, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'https://www.linkedin.com/jobs/view/' || (o_orderkey + 1000000) END AS job_url,
  CASE WHEN o_orderstatus <> 'F' THEN lower(printf('%016x', o_orderkey)) END AS second_job FROM orders""")
def board_job_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of jobs: identities, and redirects of the board unwrapped only if they are of the job itself."""
    from gleanery.functions import urls as U

    o = _orders(spark, sf_dir)
    link = F.concat(F.lit(f"{BOARD}/jobs/view/externalApply?jobId="), F.when(F.col("other"), "1").otherwise(F.col("job")), F.lit("&url=https%3A%2F%2Fapply.example%2F"), F.col("o_orderkey").cast("string"))
    unwrapped = profiles.application_link(link, F.col("job"))
    first = U.job_identity(F.concat(F.when(F.col("o_orderstatus") == "F", "https://linkedin.com.evil.example/jobs/view/").otherwise(f"{BOARD}/jobs/view/clerk-"), F.col("job")), "linkedin")
    again = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("&jk="), F.col("jk"))).otherwise("")
    second = U.job_identity(F.concat(F.lit("https://www.indeed.com/viewjob?jk="), F.col("jk"), again), "indeed")
    return o.select(F.col("o_orderkey").alias("k"), unwrapped.alias("apply_url"), first["url"].alias("job_url"), second["job_id"].alias("second_job"))


@query("""
SELECT o_custkey AS k, lower(printf('%016x', o_orderkey)) AS job_id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN 'Firm' ELSE 'Co' END AS company, o_orderstatus = 'P' AS expired FROM orders""")
def board_embedded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job records in scripts of a page: in JSON documents and in assignments; records without a proper key aren't any."""
    o = _orders(spark, sf_dir)
    done = F.col("o_orderstatus") == "F"
    first = F.to_json(F.struct(F.col("jk").alias("jobkey"), F.col("o_orderpriority").alias("title"), F.struct(F.lit("Firm").alias("name")).alias("company")))
    second = F.to_json(F.struct(F.col("jk"), F.col("o_orderpriority").alias("jobTitle"), F.lit("Co").alias("company"), (F.col("o_orderstatus") == "P").alias("isExpired")))
    part = o.groupBy(F.col("o_custkey").alias("k"), done.alias("done")).agg(F.array_join(F.collect_list(F.when(done, first).otherwise(second)), ",").alias("records"))
    script = F.when(F.col("done"), F.concat(F.lit('<script type="application/json">{"a": ['), "records", F.lit(', {"jk": "no", "title": "x"}]}</script>'))).otherwise(F.concat(F.lit("<script>window._initialData = ["), "records", F.lit("]; more()</script>")))
    pages_ = part.groupBy("k").agg(F.array_join(F.collect_list(script), "").alias("html"))
    return pages_.select("k", F.explode(profiles.embedded_jobs("html")).alias("j")).select("k", "j.job_id", "j.title", "j.company", "j.expired")


# Identity: suppliers are firms; the region of a supplier's nation says what its board page gets wrong.

_FIRMS = f"SELECT s_suppkey AS k, n_regionkey AS r, {_sql_letters('s_suppkey')} AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("k"), F.col("n_regionkey").alias("r"), letters("s_suppkey").alias("w")).withColumns({"site": F.concat(F.lit("https://www."), "w", F.lit(".example/")), "board": _company("k")})


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _firms(spark, sf_dir)
    r = F.col("r")
    link = F.when(r == 1, "https://elsewhere.example/").when(r == 2, "https://www.facebook.com/x").otherwise(F.col("site"))
    ld = F.to_json(F.struct(F.lit("Organization").alias("@type"), F.when(r == 3, "Other Name").otherwise(F.concat(F.lit("Firm "), F.col("w"))).alias("legalName"), F.col("board").alias("url")))
    html = F.concat(F.lit('<link rel="canonical" href="'), F.col("board"), F.lit('">'), F.when(r == 4, f'<link rel="canonical" href="{BOARD}/company/second/">').otherwise(""), _tag("h1", F.when(r == 3, "Other").otherwise(F.concat(F.lit("Firm "), F.col("w")))), _tag("dl", _tag("dt", "Website"), _tag("dd", _tag("a", "site", href=link)), _tag("dt", "Headquarters"), _tag("dd", "Austin"), _tag("dt", "Industry"), _tag("dd", F.col("w"))), _tag("script", ld, type="application/ld+json"))
    return profiles.company_profiles(f.select("k", "w", "r", html.alias("html"), F.col("board").alias("url"), F.lit("linkedin").alias("source")))


@query(f"""
SELECT k, CASE WHEN r = 4 THEN 'https://www.linkedin.com/company/co-' || k || '/' ELSE 'https://www.linkedin.com/company/co-' || k || '/' END AS company_url, CASE WHEN r = 3 THEN 'Other' ELSE 'Firm ' || w END AS display_name,
  CASE r WHEN 3 THEN 'other|other name' ELSE 'firm ' || w END AS observed, CASE r WHEN 1 THEN 'elsewhere.example' WHEN 2 THEN '' ELSE w || '.example' END AS hosts, 'Austin' AS place, w AS industry, r = 4 AS canonical_conflict
FROM ({_FIRMS})""")
def board_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir)
    return p.select("k", "company_url", "display_name", F.array_join("observed_keys", "|").alias("observed"), F.array_join("hosts", "|").alias("hosts"), F.array_join("locations", "|").alias("place"), F.array_join("industries", "|").alias("industry"), "canonical_conflict")


@query(f"""
SELECT k, w || '.example' AS official_host, 'firm ' || w AS names,
  sha256('{{"names": ["firm ' || w || '"], "official_host": "' || w || '.example", "slug": "' || k || '"}}') AS fingerprint FROM ({_FIRMS})""")
def identity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _firms(spark, sf_dir).select(F.col("k").cast("string").alias("slug"), F.concat(F.lit("Firm "), "w").alias("firm"), F.col("site").alias("website"), F.upper(F.concat(F.lit("firm "), "w")).alias("legal_name"), F.lit(None).cast("array<string>").alias("company_aliases"))
    return identity.targets(f).select(F.col("slug").cast("long").alias("k"), "official_host", F.array_join("names", "|").alias("names"), "fingerprint")


_VERDICT = """CASE r WHEN 0 THEN 'verified:profile_domain_and_name' WHEN 1 THEN 'conflict:official_domain_conflict' WHEN 2 THEN 'unverified:name_only_not_identity' WHEN 3 THEN 'unverified:name_or_legal_entity_conflict' ELSE 'conflict:company_redirect_conflict' END"""


@query(f"SELECT k, {_VERDICT} AS verdict FROM ({_FIRMS})")
def identity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir)
    none = F.lit(None).cast("string")
    facts = p.withColumns({"official_host": F.concat("w", F.lit(".example")), "names": F.array(F.concat(F.lit("firm "), "w")), "proof_source_host": none, "proof_target": none})
    return identity.evaluated(facts).select("k", F.concat_ws(":", "status", "reason").alias("verdict"))


@query(f"""
WITH v AS (SELECT r AS slug, k, split_part({_VERDICT}, ':', 1) AS status FROM ({_FIRMS})),
g AS (SELECT slug, count(*) AS n, count(*) FILTER (status = 'verified') AS ok, max(status = 'conflict') AS bad, min(k) FILTER (status = 'verified') AS one FROM v GROUP BY slug)
SELECT slug, CASE WHEN n > 5 THEN 'ambiguous' WHEN ok = 1 THEN 'verified' WHEN ok > 1 THEN 'ambiguous' WHEN bad THEN 'conflict' ELSE 'unverified' END AS status,
  CASE WHEN n <= 5 AND ok = 1 THEN 'https://www.linkedin.com/company/co-' || one || '/' END AS company_url FROM g""")
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as firms with the companies of their suppliers as candidates."""
    p = _profiles(spark, sf_dir)
    none = F.lit(None).cast("string")
    facts = p.withColumns({"official_host": F.concat("w", F.lit(".example")), "names": F.array(F.concat(F.lit("firm "), "w")), "proof_source_host": none, "proof_target": none})
    records = identity.evaluated(facts).withColumn("slug", F.col("r"))
    return identity.resolved(records).select("slug", "status", "company_url")


@query(f"""
SELECT k, CASE r WHEN 0 THEN '' WHEN 1 THEN 'not_verified' WHEN 2 THEN 'target_changed' WHEN 3 THEN 'company_mismatch' ELSE 'missing_or_misbound_identity_evidence' END AS reason FROM ({_FIRMS})""")
def import_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _firms(spark, sf_dir).withColumn("slug", F.col("k").cast("string")), F.col("r")
    now = identity.targets(f.select("slug", F.col("w").alias("firm"), F.col("site").alias("website"), F.lit(None).cast("string").alias("legal_name"), F.lit(None).cast("array<string>").alias("company_aliases")))
    rows = f.join(now.select("slug", "fingerprint"), "slug").select(
        "slug", F.lit("linkedin").alias("source"), F.lit(identity.POLICY).alias("policy"), F.when(r == 1, "unverified").otherwise("verified").alias("status"), F.when(r == 2, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.col("board").alias("company_url"),
        F.when(r == 3, f"{BOARD}/company/other/").otherwise(F.col("board")).alias("stated_company"), F.when(r == 4, "search_result").otherwise("official_link").alias("evidence_kind"), F.concat("w", F.lit(".example")).alias("evidence_source_host"), F.col("board").alias("evidence_target"), F.lit(None).cast("string").alias("evidence_target_host"),
    )
    good, bad = identity.guarded(rows, now)
    return good.select(F.col("slug").cast("long").alias("k"), F.lit("").alias("reason")).union(bad.select(F.col("slug").cast("long"), "quarantine_reason"))


@query(f"""
SELECT k, CASE WHEN r IN (0, 1) THEN 'official_same_as' WHEN r = 2 THEN 'official_link' ELSE '' END AS kind, CASE WHEN r = 4 THEN 0 ELSE 1 END AS n_pages FROM ({_FIRMS})""")
def official_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official sites: the board page by the site's own statement, by a link in its footer, or only in a testimonial, which counts for nothing."""
    f, r = _firms(spark, sf_dir), F.col("r")
    ld = _tag("script", F.to_json(F.struct(F.array(F.struct(F.lit("LegalService").alias("@type"), F.concat(F.lit("Firm "), F.col("w")).alias("name"), F.col("site").alias("url"), F.array("board").alias("sameAs"))).alias("@graph"))), type="application/ld+json")
    html = F.concat(F.when(r <= 1, ld).otherwise(""), F.when(r == 2, _tag("footer", _tag("a", "in", href=F.col("board")))).otherwise(""), F.when(r >= 3, _tag("section", _tag("a", "LinkedIn", href=F.col("board")), class_="testimonials")).otherwise(""), F.when(r < 4, _tag("a", "About", href="/about-us#team")).otherwise(""), _tag("a", "Terms", href="/terms"))
    p = f.select("k", html.alias("html"), F.col("site").alias("url"), F.lit("linkedin").alias("source"), F.concat("w", F.lit(".example")).alias("official_host"), F.array(F.concat(F.lit("firm "), "w")).alias("names"))
    return profiles.official_candidates(p).select("k", F.coalesce(F.get("found", F.lit(0))["kind"], F.lit("")).alias("kind"), F.size("pages").alias("n_pages"))


# Hiring: customers are firms, the first and the last of their orders two snapshots.

_STATUS = "CASE {} WHEN 'F' THEN 'hiring' WHEN 'O' THEN 'unknown' ELSE 'no_public_jobs_found' END"


@query(f"""
WITH x AS (SELECT o_custkey AS k, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1),
s AS (SELECT k, {_STATUS.format("p.o_orderstatus")} AS before, CASE WHEN a <> b THEN {_STATUS.format("c.o_orderstatus")} END AS now FROM x JOIN orders p ON p.o_orderkey = a JOIN orders c ON c.o_orderkey = b)
SELECT k, coalesce(now, before) AS status, now IS NOT NULL AS checked, CASE WHEN before <> 'unknown' AND coalesce(now, 'unknown') = 'unknown' THEN before END AS history FROM s""")
def hiring_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ends = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    status = F.expr(_STATUS.format("o_orderstatus"))
    shot = lambda df: df.select(F.col("o_custkey").alias("slug"), F.lit("linkedin").alias("board"), status.alias("status"), F.when(status == "hiring", True).alias("is_hiring"), F.array().cast("array<string>").alias("jobs"), F.col("o_orderdate").alias("checked_at"), F.lit("exhausted").alias("stop_reason"))
    before = shot(o.join(ends.select(F.col("a").alias("o_orderkey")), "o_orderkey", "left_semi"))
    now = shot(o.join(ends.where("a <> b").select(F.col("b").alias("o_orderkey")), "o_orderkey", "left_semi"))
    return hiring.merged_boards(before, now).select(F.col("slug").alias("k"), "status", "checked", F.col("history.status").alias("history"))


@query(f"""
WITH b AS (SELECT o_custkey AS k, o_orderpriority AS board, {_STATUS.format("max_by(o_orderstatus, o_orderkey)")} AS status FROM orders GROUP BY ALL), j AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT k, CASE WHEN max(status = 'hiring') THEN 'hiring' WHEN min(status = 'no_public_jobs_found') THEN 'no_public_jobs_found' ELSE 'unknown' END AS status, any_value(n) AS observed_job_count, string_agg(board, '|' ORDER BY board) AS checked_sources
FROM b JOIN j USING (k) GROUP BY k""")
def hiring_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"slug": F.col("o_custkey"), "board": F.col("o_orderpriority"), "job_id": F.col("o_orderkey").cast("string"), "url": F.lit(None).cast("string"), "ord": F.col("o_orderkey")})
    last = o.groupBy("slug", "board").agg(F.max_by("o_orderstatus", "o_orderkey").alias("s")).withColumn("status", F.expr(_STATUS.format("s")))
    boards_ = last.select("slug", "board", "status", F.when(F.col("status") == "hiring", True).alias("is_hiring"), F.lit("exhausted").alias("stop_reason"), F.lit(True).alias("checked"))
    jobs = hiring.unique_jobs(o.unionByName(o).select("slug", "board", "job_id", "url", "ord"))
    return hiring.aggregated(boards_, jobs).select(F.col("slug").alias("k"), "status", "observed_job_count", F.array_join("checked_sources", "|").alias("checked_sources"))


@query("""
WITH p AS (SELECT o_custkey AS k, row_number() OVER w AS n, o_orderstatus = 'P' AS bad, lead(o_orderkey) OVER w IS NULL AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
u AS (SELECT *, coalesce(sum(bad::INT) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
g AS (SELECT k, count(*) FILTER (NOT bad) AS jobs, max_by(bad, n) AS bad, max_by(last, n) AS last, max(n) AS n FROM u WHERE before = 0 AND n <= 3 GROUP BY k)
SELECT k, jobs AS observed_job_count, CASE WHEN jobs > 0 THEN 'hiring' WHEN bad THEN 'unknown' ELSE 'no_public_jobs_found' END AS status, CASE WHEN bad THEN 'blocked' WHEN last THEN 'exhausted' WHEN n >= 3 THEN 'max_pages' ELSE 'exhausted' END AS stop_reason FROM g""")
def listing_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are listing pages of one job each; a pending one is a page that was refused."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages_ = o.select(F.col("o_custkey").alias("slug"), F.lit("linkedin").alias("board"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "blocked").otherwise("ok").alias("status"), F.array(F.struct(F.col("o_orderkey").cast("string").alias("job_id"))).alias("jobs"), F.when(F.lead("o_orderkey").over(w).isNotNull(), "https://next.example").alias("next_url"))
    return hiring.listing_walk(pages_).select(F.col("slug").alias("k"), "observed_job_count", "status", "stop_reason")


@query("""
SELECT o_orderkey AS k, coalesce(max((o_orderstatus = 'P')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM orders""")
def refusal_latches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return hiring.refusal_latch(o, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("k"), "stopped")


@query("""
SELECT o_custkey AS k, coalesce(min_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F'), '') AS description, CASE WHEN max(o_orderstatus = 'F') THEN 'ok' ELSE 'partial' END AS status, count(*) AS attempts FROM orders GROUP BY 1""")
def detail_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are attempts to read one job; filled ones have a description, of which the first counts."""
    done = F.col("o_orderstatus") == "F"
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.when(done, F.col("o_orderpriority")).alias("description"), F.when(done, "ok").otherwise("partial").alias("status"))
    return hiring.detail_attempts(a, ["k"], "o_orderkey").select("k", F.coalesce("description", F.lit("")).alias("description"), "status", "attempts")


@query("""
SELECT page_id, CASE WHEN url LIKE '%.org%' THEN 'ok' WHEN url LIKE 'https%' THEN 'ok' ELSE 'timeout' END AS status, CASE WHEN url LIKE '%.org%' THEN 'old' WHEN url LIKE 'https%' THEN 'new' ELSE '' END AS title FROM pages""")
def page_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of .org sites were read at once; of the others those by https are on a second try."""
    p = table(spark, sf_dir, "pages")
    first, again = F.col("url").contains(".org"), F.col("url").startswith("https")
    prior = p.select("page_id", F.concat("url", F.lit("?p="), F.col("page_id")).alias("url"), F.when(first, "ok").otherwise("timeout").alias("status"), F.when(first, "old").otherwise("").alias("title"), F.col("page_id").alias("ord"))
    retry = p.select(F.concat("url", F.lit("?p="), F.col("page_id")).alias("url"), F.when(again, "ok").otherwise("timeout").alias("status"), F.when(again, "new").otherwise("").alias("title"), F.col("page_id").alias("ord"))
    return merge.retried_pages(prior, retry).select("page_id", "status", "title")


@query(f"""
SELECT c_custkey AS k, CASE WHEN c_nationkey = 0 THEN 'not_linked_yet' WHEN c_acctbal >= 0 THEN 'linked' ELSE 'names_masked' END AS status, CASE WHEN c_nationkey <> 0 AND c_acctbal >= 0 THEN 2 ELSE 0 END AS named, CASE WHEN c_nationkey <> 0 AND c_acctbal < 0 THEN 2 ELSE 0 END AS masked,
  CASE WHEN c_nationkey <> 0 AND c_acctbal >= 0 THEN 'Ann ' || upper(left(w, 1)) || substr(w, 2) END AS owner FROM (SELECT *, {_sql_letters("c_custkey")} AS w FROM customer)""")
def board_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a board: people by name or hidden, and who of them owns the firm by title."""
    c = table(spark, sf_dir, "customer")
    none, known = F.lit(None).cast("string"), F.col("c_acctbal") >= 0
    person = lambda name, title: F.struct(F.when(known, name).otherwise("LinkedIn Member").alias("name"), F.lit(title).alias("title"), none.alias("email"), none.alias("profile_url"))
    people = F.array(person(F.lit("Bob Clerk"), "Clerk"), person(F.concat(F.lit("Ann "), F.initcap(letters("c_custkey"))), "Owner"))
    rows = c.select(F.col("c_custkey").alias("slug"), F.when(F.col("c_nationkey") != 0, _company("c_custkey")).alias("linkedin_company"), F.when(F.col("c_nationkey") != 0, people).otherwise(F.array().cast("array<struct<name:string,title:string,email:string,profile_url:string>>")).alias("contacts"), none.alias("owner"))
    states = imports.board_states(rows)
    who = rows.select(F.col("slug").alias("_s"), imports.owner(F.filter("contacts", lambda x: x["name"] != "LinkedIn Member"), F.col("owner")).alias("owner"))
    return states.join(who, F.col("slug") == F.col("_s")).select(F.col("slug").alias("k"), "status", F.col("contacts_named").alias("named"), F.col("contacts_masked").alias("masked"), "owner")


# Notes: customers are businesses, their orders contacts in a section.


@query(f"""
SELECT c_custkey AS k, 'Firm ' || {_sql_letters("c_custkey")} AS name, 'City ' || c_nationkey AS city, c_mktsegment AS category, '+1-512-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone,
  CASE WHEN c_acctbal >= 0 THEN 'https://f' || c_custkey || '.example' END AS website, CASE WHEN c_acctbal >= 0 THEN 'call-ready' ELSE 'prospect' END AS status FROM customer""")
def note_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses written as notes and read back."""
    return documents.businesses(_notes(spark, sf_dir)).select(F.col("slug").cast("long").alias("k"), "name", "city", "category", "phone", "website", "status")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = table(spark, sf_dir, "customer"), F.lit(None).cast("string")
    rich = F.col("c_acctbal") >= 0
    number = F.concat(F.lit("(512) 555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    b = c.select(
        F.col("c_custkey").cast("string").alias("slug"), F.concat(F.lit("Firm "), letters("c_custkey")).alias("name"), F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("city"), F.col("c_mktsegment").alias("category"), none.alias("practice"), number.alias("phone"),
        F.when(rich, F.concat(F.lit("https://f"), F.col("c_custkey").cast("string"), F.lit(".example"))).alias("website"), none.alias("address"), F.when(rich, "call-ready").alias("status"), F.lit("Comptroller").alias("source"),
    )
    return sinks.rendered_notes(b).withColumn("path", F.concat("slug", F.lit(".md")))


@query(f"""
SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, 'Ann ' || {_sql_letters("o_orderkey")} AS name, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'Clerk' END AS title, 'a' || o_orderkey || '@x.example' AS email FROM orders""")
def note_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts put into a section of notes as bullets and read back."""
    o = table(spark, sf_dir, "orders")
    bullet = documents.contact_bullet(F.concat(F.lit("Ann "), letters("o_orderkey")), F.when(F.col("o_orderstatus") != "O", "Clerk"), F.concat(F.lit("A"), F.col("o_orderkey").cast("string"), F.lit("@x.example")), F.lit(None).cast("string"))
    lines = o.groupBy(F.col("o_custkey").cast("string").alias("slug")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", bullet.alias("b")))), lambda x: x["b"]), "\n").alias("_b"))
    n = _notes(spark, sf_dir).join(lines, "slug").withColumn("text", sinks.replaced_section(F.col("text"), "Contacts", F.col("_b"))).drop("_b")
    got = documents.note_contacts(documents.businesses(n))
    return got.select(F.col("slug").cast("long").alias("k"), F.col("ord").cast("long").alias("place"), "name", "title", "email")


@query("SELECT c_custkey AS k, 'https://n' || c_custkey || '.example' AS website, 'paused ''x''' AS research, c_mktsegment AS category, 4 AS sections FROM customer")
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter set in place and added, and the rest of the note as it was."""
    n = _notes(spark, sf_dir)
    text = sinks.set_front(sinks.set_front(F.col("text"), "website", F.concat(F.lit("https://n"), "slug", F.lit(".example"))), "research_status", F.lit('paused "x"'))
    n = n.withColumn("text", text)
    return n.select(F.col("slug").cast("long").alias("k"), documents.front_value("text", "website").alias("website"), documents.front_value("text", "research_status").alias("research"), documents.unlinked(documents.front_value("text", "category")).alias("category"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^(## .*)$"), 1)).alias("sections"))


@query("""
SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN '+1-512-555-9999' ELSE '+1-512-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone, CASE WHEN c_acctbal >= 0 THEN 'https://f' || c_custkey || '.example' ELSE 'https://new.example' END AS website FROM customer""")
def field_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes overwrite fields, but never with nothing, and a site never with a directory's."""
    b = documents.businesses(_notes(spark, sf_dir)).select("slug", "phone", "website")
    poor = F.col("website").isNull()
    changes = b.select("slug", F.when(poor, "+1-512-555-9999").otherwise("").alias("phone"), F.when(poor, "https://new.example").otherwise("https://www.yelp.com/biz/x").alias("website"))
    return merge.update_fields(b, changes).select(F.col("slug").cast("long").alias("k"), "phone", "website")


@query("""
SELECT s_suppkey AS k, CASE WHEN n_regionkey = 0 THEN 'applied' WHEN n_regionkey = 1 THEN 'path and slug differ' WHEN n_regionkey = 2 THEN 'contact without name' WHEN n_regionkey = 3 THEN 'note not found' ELSE 'path leaves the folder' END AS outcome
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _firms(spark, sf_dir), F.col("r")
    slug = F.col("k").cast("string")
    path = F.when(r == 1, "Businesses/another.md").when(r == 4, F.concat(F.lit("../"), slug, F.lit(".md"))).otherwise(F.concat(F.lit("Businesses/"), slug, F.lit(".md")))
    rows = f.select(slug.alias("slug"), path.alias("path"), F.array(F.struct(F.when(r == 2, "").otherwise("Ann Able").alias("name"))).alias("contacts"))
    notes = f.where("r <> 3").select(slug.alias("slug"), F.concat(slug, F.lit(".md")).alias("path"))
    good, errors, _ = imports.applied(rows, notes)
    return good.select(F.col("slug").cast("long").alias("k"), F.lit("applied").alias("outcome")).union(errors.select(F.col("slug").cast("long"), "error"))


# Directories: customers are permits, suppliers contractors, parts places on a map, nations brokers.


def bucket(key: str) -> Column:
    """About 1,000 rows have the same: a payload's size doesn't grow with its table."""
    return F.floor(F.col(key) / 1000).cast("string")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, p = (table(spark, sf_dir, x) for x in ("customer", "supplier", "part"))
    none = F.lit(None).cast("array<string>")
    body = lambda *x: F.to_json(F.collect_list(F.struct(*x)))
    row = lambda df, by, recipe, kind, hints, text: df.groupBy(F.concat_ws("-", F.col(by).cast("string"), bucket(df.columns[0])).alias("_g")).agg(text.alias("body")).select(F.lit(recipe).alias("recipe"), F.lit(kind).alias("kind"), hints.alias("parse"), F.concat(F.lit(f"https://{kind}.example/"), "_g").alias("source_url"), "body")
    permits = row(c.unionByName(c), "c_nationkey", "comptroller_x", "soda", none, body(F.concat(F.lit("Firm "), letters("c_custkey")).alias("outlet_name"), F.lit("AUSTIN").alias("outlet_city"), F.concat(F.col("c_custkey").cast("string"), F.lit(" Oak St")).alias("outlet_address"), F.lit("78701").alias("outlet_zip_code")))
    kind = F.when(F.col("s_acctbal") < 0, "A/C Technician").otherwise("A/C Contractor")
    licences = row(s, "s_nationkey", "tdlr_all", "soda", F.array(F.lit("tdlr")), body(kind.alias("license_type"), F.concat(F.lit("Cool "), letters("s_suppkey")).alias("business_name"), F.concat(F.lit("512555"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0")).alias("business_telephone"), F.lit("WACO, TX 76701").alias("business_city_state_zip")))
    tags = F.map_filter(F.create_map(F.lit("name"), F.concat(F.lit("Cafe "), letters("p_partkey")), F.lit("addr:city"), F.lit("round rock"), F.lit("website"), F.when(F.col("p_size") > 25, F.concat(F.lit("https://c"), F.col("p_partkey").cast("string"), F.lit(".example/?a=1"))).otherwise("https://www.yelp.com/biz/x")), lambda _, v: v.isNotNull())
    elements = row(p, "p_brand", "osm_x", "overpass", none, F.to_json(F.struct(F.collect_list(F.struct(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), tags.alias("tags"))).alias("elements"))))
    n = table(spark, sf_dir, "nation")
    brokers = row(n, "n_regionkey", "trec_x", "soda", F.array(F.lit("trec")), body(F.when(F.col("n_regionkey") == 0, "Sales Agent").otherwise("Broker Company").alias("license_type"), F.lit("Active").alias("status"), F.concat(F.lit("Realty "), letters("n_nationkey")).alias("full_name"), F.lit("travis").alias("county")))
    return permits.unionByName(licences).unionByName(elements).unionByName(brokers)


@query(f"""
SELECT 'Firm ' || {_sql_letters("c_custkey")} AS firm, 'Comptroller' AS source, '' AS phone, 'Austin' AS city, c_custkey || ' Oak St, Austin, TX, 78701' AS address, '' AS site FROM customer
UNION ALL SELECT 'Cool ' || {_sql_letters("s_suppkey")}, 'TDLR', '+1-512-555-' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0'), 'Waco', 'WACO, TX 76701', '' FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 'Cafe ' || {_sql_letters("p_partkey")}, 'OpenStreetMap', '', 'Round Rock', 'Round Rock', CASE WHEN p_size > 25 THEN 'https://c' || p_partkey || '.example/' ELSE '' END FROM part
UNION ALL SELECT 'Realty ' || {_sql_letters("n_nationkey")}, 'TREC', '', 'Travis', 'Travis, TX', '' FROM nation WHERE n_regionkey <> 0""")
def directory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directories.parsed(_payloads(spark, sf_dir)).select("firm", "source", "phone", "city", "address", F.col("candidate_website").alias("site"))


@query("""
SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'Filled' ELSE 'Open' END AS member, o_orderpriority AS name, CASE WHEN o_orderstatus = 'F' THEN 'a "quoted", field' ELSE o_orderkey || chr(10) || 'over lines' END AS note FROM orders WHERE o_orderstatus <> 'P'""")
def archive_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters in zip archives: filled orders lie in the member that their recipe names, behind another one, open ones in the only CSV; those in progress are of a recipe that nobody asks for."""
    folder = scratch(spark)
    o = table(spark, sf_dir, "orders").withColumn("recipe", F.when(F.col("o_orderstatus") == "F", "tbpe_filled").when(F.col("o_orderstatus") == "O", "tbpe_open").otherwise("tbpe_other"))
    note = F.when(F.col("o_orderstatus") == "F", '"a ""quoted"", field"').otherwise(F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('\nover lines"')))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", note)
    # About 1,000 orders an archive, whatever their number.
    text = F.concat(F.lit("\ufeffKey, Name ,Note\r\n"), F.array_join(F.collect_list(line), "\r\n"), F.lit("\r\n"))
    every = o.groupBy("recipe", F.floor(F.col("o_orderkey") / 4000).alias("n")).agg(text.alias("text"))
    other = F.lit("key,name\r\n1,wrong\r\n")
    members = F.when(F.col("recipe") == "tbpe_filled", F.create_map(F.lit("a/First.CSV"), other, F.lit("Filled.csv"), F.col("text"))).otherwise(F.create_map(F.lit("readme.txt"), F.lit("no roster"), F.lit("Open.csv"), F.col("text")))
    archives.write(every.select("recipe", F.concat(F.lit("part-"), F.col("n").cast("string"), F.lit(".zip")).alias("archive"), members.alias("members")), folder)
    found = archives.read(spark, folder, {"tbpe_filled": "Filled.csv", "tbpe_open": "Missing.csv"}).where(F.col("recipe").isin("tbpe_filled", "tbpe_open"))
    return found.select(F.col("fields")["key"].cast("long").alias("k"), F.regexp_replace("member", r"\.csv$", "").alias("member"), F.col("fields")["name"].alias("name"), F.col("fields")["note"].alias("note"))


@query(f"""
SELECT 'Smile ' || {_sql_letters("s_suppkey")} AS firm, '+1-512-555-' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') AS phone, s_suppkey || ' Elm, Suite 2, Austin, TX, 78701' AS address FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 'Dr. Ann ' || {_sql_letters("s_suppkey")}, '', 'Texas, TX' FROM supplier WHERE s_acctbal < 0""")
def directory_dentists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV payloads through the dispatcher, each with a header of its own; the second has no practice names, and rows that are short, too long or empty."""
    s, w = table(spark, sf_dir, "supplier"), letters("s_suppkey")
    tel = F.concat(F.lit("(512) 555-"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"))
    first = F.concat(F.lit('"Smile '), w, F.lit('",'), tel, F.lit(',"'), F.col("s_suppkey").cast("string"), F.lit(' Elm, Suite 2",AUSTIN,78701'))
    second = F.concat(F.lit("Ann,"), w, F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(",,,,surplus"), F.lit("\n"))
    half = lambda where, head, line, name: s.where(where).groupBy(F.floor(F.col("s_suppkey") / 1000).alias("n")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), "\n")).alias("body")).select(F.lit("tsbde_x").alias("recipe"), F.lit("csv").alias("kind"), F.lit(None).cast("array<string>").alias("parse"), F.concat(F.lit(f"https://{name}.example/"), F.col("n").cast("string")).alias("source_url"), "body")
    p = half("s_acctbal >= 0", "Practice Name,PHONE,Practice Address,city,Zip Code\n", first, "names").unionByName(half("s_acctbal < 0", "first name,Last Name,Phone,City\n", second, "people"))
    return directories.parsed(p).select("firm", "phone", "address")


@query("""
SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'empty_payload' ELSE 'roster_without_places' END AS reason FROM orders WHERE o_orderstatus <> 'O'""")
def payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that no reader takes come back with a reason."""
    o, open_ = table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O"
    p = o.select(F.when(F.col("o_orderstatus") == "F", "tbpe_x").otherwise("comptroller_x").alias("recipe"), F.when(F.col("o_orderstatus") == "F", "zip_csv").otherwise("soda").alias("kind"), F.lit(None).cast("array<string>").alias("parse"), F.col("o_orderkey").cast("string").alias("source_url"), F.when(F.col("o_orderstatus") == "P", " ").when(open_, "[]").otherwise("name\n").alias("body"))
    return directories.rejected(p).select(F.col("source_url").cast("long").alias("k"), "reason")


@query(f"""
SELECT r.n_nationkey AS k, 'Clinic ' || {_sql_letters("r.n_nationkey")} AS firm, '+1-512-555-' || lpad(r.n_nationkey::VARCHAR, 4, '0') AS phone, 'Austin' AS city FROM nation r WHERE n_regionkey <> 1""")
def directory_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider registry: pharmacies are left out, a trade name goes before the organisation's, the location before the mailing address."""
    n = table(spark, sf_dir, "nation")
    at = lambda purpose, tel, city: F.struct(F.lit(purpose).alias("address_purpose"), tel.alias("telephone_number"), F.lit(city).alias("city"))
    tel = F.concat(F.lit("512-555-"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    one = F.struct(
        F.col("n_nationkey").cast("string").alias("number"), F.struct(F.col("n_name").alias("organization_name")).alias("basic"), F.array(F.struct(F.concat(F.lit("Clinic "), letters("n_nationkey")).alias("organization_name"), F.lit("Doing Business As").alias("type"), F.lit("3").alias("code"))).alias("other_names"),
        F.array(F.struct(F.when(F.col("n_regionkey") == 1, "Pharmacy").otherwise("Family Medicine").alias("desc"))).alias("taxonomies"), F.array(at("MAILING", F.lit("512-555-9999"), "WACO"), at("LOCATION", tel, "AUSTIN")).alias("addresses"),
    )
    p = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("body")).select(F.lit("nppes_x").alias("recipe"), F.lit("nppes").alias("kind"), F.lit(None).cast("array<string>").alias("parse"), F.concat(F.lit("https://npi.example/"), F.col("n_regionkey").cast("string")).alias("source_url"), "body")
    return directories.parsed(p).select(F.col("npi").cast("int").alias("k"), "firm", "phone", "city")


@query(f"""
SELECT s_suppkey AS k, 'Firm ' || {_sql_letters("s_suppkey")} AS firm, 'O''Hara ' || {_sql_letters("s_suppkey")} AS attorney, '+1-512-555-' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') AS phone, 'Austin' AS city FROM supplier""")
def directory_attorneys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of an attorney directory: people in JSON-LD with the firm they work at."""
    s = table(spark, sf_dir, "supplier")
    work = F.struct(F.lit("LegalService").alias("@type"), F.concat(F.lit("Firm "), letters("s_suppkey")).alias("name"), F.concat(F.lit("512.555."), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0")).alias("telephone"), F.struct(F.array(F.lit("3 Law Way"), F.lit("Ste 2")).alias("streetAddress"), F.lit("Austin").alias("addressLocality")).alias("address"))
    person = F.struct(F.lit("Person").alias("@type"), F.concat(F.lit("O&#39;Hara "), letters("s_suppkey")).alias("name"), F.concat(F.lit("https://dir.example/"), F.col("s_suppkey").cast("string")).alias("url"), work.alias("workLocation"))
    body = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"WebSite"}</script><script type="application/ld+json">'), F.to_json(F.collect_list(person)), F.lit("</script></html>"))
    p = s.groupBy("s_nationkey", bucket("s_suppkey").alias("b")).agg(body.alias("body")).select(F.lit("justia_pi").alias("recipe"), F.lit("html").alias("kind"), F.lit(None).cast("array<string>").alias("parse"), F.concat(F.lit("https://dir.example/austin/texas/"), F.col("s_nationkey").cast("string"), F.lit("?p="), "b").alias("source_url"), "body")
    return directories.parsed(p).select(F.regexp_extract("profile_url", r"(\d+)$", 1).try_cast("long").alias("k"), "firm", "attorney", "phone", "city")


@query(f"""
SELECT CASE WHEN c_acctbal < 0 THEN 'State Farm ' ELSE 'Firm ' END || {_sql_letters("c_custkey")} AS firm, CASE WHEN c_acctbal < 0 THEN 'junk_name' ELSE '' END AS reason FROM customer""")
def candidate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("")
    c = table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_acctbal") < 0, "State Farm ").otherwise("Firm "), letters("c_custkey")).alias("firm"), none.alias("phone"), none.alias("address"), none.alias("candidate_website"))
    kept, out = entities.screened(c)
    return kept.select("firm", F.lit("").alias("reason")).union(out.select("firm", "reason"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, {_sql_letters("c_custkey")} AS w, c_acctbal AS b FROM customer)
SELECT w AS slug, 'same' AS change FROM c WHERE b < 0 UNION ALL SELECT 'old-' || w, 'updated' FROM c WHERE b >= 5000 UNION ALL SELECT 'firm-' || w, 'created' FROM c WHERE b >= 0 AND b < 5000""")
def directory_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are businesses no registry lists, rich ones are listed by a name that is part of theirs and get an address, the others are new."""
    c = table(spark, sf_dir, "customer").withColumns({"w": letters("c_custkey"), "none": F.lit(None).cast("string")})
    known = c.where("c_acctbal < 0 or c_acctbal >= 5000").select(
        F.when(F.col("c_acctbal") < 0, F.col("w")).otherwise(F.concat(F.lit("old-"), "w")).alias("slug"), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("Alone "), "w")).otherwise(F.concat(F.lit("Firm "), "w", F.lit(" of Austin"))).alias("name"), F.lit("Austin").alias("city"), F.lit("Roofing").alias("category"),
        *[F.col("none").alias(x) for x in ("practice", "phone", "website", "address", "linkedin_company")], F.lit("prospect").alias("status"), F.lit("Comptroller").alias("source"), F.col("none").alias("email"),
    )
    body = F.to_json(F.collect_list(F.struct(F.concat(F.lit("Firm "), "w").alias("outlet_name"), F.lit("AUSTIN").alias("outlet_city"), F.lit("1 Oak St").alias("outlet_address"))))
    p = c.where("c_acctbal >= 0").groupBy(bucket("c_custkey").alias("b")).agg(body.alias("body")).select(F.lit("comptroller_roofing").alias("recipe"), F.lit("soda").alias("kind"), F.lit(None).cast("array<string>").alias("parse"), F.concat(F.lit("https://data.example/"), "b").alias("source_url"), "body")
    return prep.ingest(p, known, "roofing")[0].select("slug", "change")


@query("""
SELECT s_suppkey AS k, 'https://f' || s_suppkey || '.example' AS website FROM supplier WHERE s_acctbal >= 0""")
def website_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sites: a directory, one that answers badly, one of somebody else, and, for suppliers not in debt, the right one."""
    s = table(spark, sf_dir, "supplier").withColumns({"slug": F.col("s_suppkey").cast("string"), "w": letters("s_suppkey")})
    b = s.select("slug", F.concat(F.lit("Firm "), "w", F.lit(" Partners")).alias("name"), F.lit(None).cast("string").alias("website"))
    tried = F.array(*[F.struct(F.lit(i).alias("ord"), u.alias("url"), F.lit(code).alias("http_code"), t.alias("text")) for i, (u, code, t) in enumerate([
        (F.lit("https://www.yelp.com/biz/x"), 200, F.col("w")), (F.concat(F.lit("https://gone"), "slug", F.lit(".example/")), 404, F.col("w")), (F.concat(F.lit("https://else"), "slug", F.lit(".example/")), 200, F.lit("somebody else")), (F.concat(F.lit("https://f"), "slug", F.lit(".example/")), 200, F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("Welcome to Firm "), "w", F.lit(" Partners"))).otherwise("parked"))])])
    t = s.select("slug", F.explode(tried).alias("t")).select("slug", "t.*")
    landed = t.select("url", F.col("url").alias("final_url"), "http_code", "text").dropDuplicates(["url"])
    return entities.website_matches(b, t.select("slug", "url", "ord"), landed).select(F.col("slug").cast("long").alias("k"), "website")


# Contacts: customers are people of nations, once by name, once by an address that fits it.


@query(f"""
SELECT c_nationkey AS slug, 'Dana ' || upper(left(w, 1)) || substr(w, 2) AS name, 'dana.' || w || '@n.example' AS email, 2 AS n_pages FROM (SELECT c_nationkey, {_sql_letters("c_custkey")} AS w FROM customer)
UNION ALL SELECT DISTINCT c_nationkey, NULL, 'info@n.example', 1 FROM customer""")
def contact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contacts(spark, sf_dir)
    return entities.merged_contacts(c).select(F.col("slug").cast("int").alias("slug"), "name", "email", F.size("source_pages").alias("n_pages"))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = table(spark, sf_dir, "customer").withColumn("w", letters("c_custkey")), F.lit(None).cast("string")
    no = [F.lit(False).alias(x) for x in ("schema_person", "from_attorney_bio", "from_careers_privacy", "from_linkedin")]
    row = lambda df, name, email, page, ord_: df.select(F.col("c_nationkey").cast("string").alias("slug"), name.alias("name"), none.alias("title"), email.alias("email"), none.alias("phone"), none.alias("profile_url"), F.array(page).alias("source_pages"), F.array(F.lit("website")).alias("sources"), *no, ord_.cast("long").alias("ord"))
    named = row(c, F.concat(F.lit("Dana "), F.initcap("w")), none, F.lit("p1"), F.col("c_custkey") * 3)
    mailed = row(c, none, F.concat(F.lit("dana."), "w", F.lit("@n.example")), F.lit("p2"), F.col("c_custkey") * 3 + 1)
    inbox = row(c, F.lit("Contact Us"), F.lit("info@n.example"), F.lit("p3"), F.col("c_custkey") * 3 + 2)
    return named.unionByName(mailed).unionByName(inbox)


@query("SELECT DISTINCT c_nationkey AS slug, 'info@n.example' AS email, 1 AS n_pages FROM customer")
def inbox_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared inbox of firms none of whose people is known."""
    c = _contacts(spark, sf_dir).where("email = 'info@n.example'")
    return ranking.inbox_fallback(entities.merged_contacts(c)).select(F.col("slug").cast("int").alias("slug"), "email", F.size("pages").alias("n_pages"))


# Pages: each of the table with markup written beside what it has.


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("w", letters("page_id"))
    org = F.to_json(F.struct(F.lit("LegalService").alias("@type"), F.struct(F.lit("Person").alias("@type"), F.concat(F.lit("Dana "), F.initcap("w")).alias("name")).alias("employee")))
    more = F.concat(_tag("script", org, type="application/ld+json"), _tag("a", "call", href=F.concat(F.lit("tel:(512) 555-"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"))), _tag("a", "x", href=F.concat(F.lit("/attorneys/"), "w")), _tag("a", "y", href=F.concat(F.lit("/attorneys/"), F.upper("w"))), _tag("a", "z", href="https://other.example/attorneys/z"))
    return p.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), more).alias("html"), "w")


@query(f"""
SELECT page_id, 'LegalService' AS types, 'Dana ' || upper(left(w, 1)) || substr(w, 2) AS people, list_contains([p], p) AS has_phone FROM (SELECT page_id, {_sql_letters("page_id")} AS w, '+1-512-555-' || lpad((page_id % 10000)::VARCHAR, 4, '0') AS p FROM pages)""")
def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    own = F.concat(F.lit("+1-512-555-"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"))
    return p.select("page_id", F.try_element_at(schema_types("html"), F.lit(1)).alias("types"), F.array_join(F.transform(schema_people("html"), lambda x: x["name"]), "|").alias("people"), F.array_contains(H.phones("html"), own).alias("has_phone"))


@query(f"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/attorneys/' || {_sql_letters("page_id")} AS link FROM pages""")
def bio_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to people's pages: each once whatever its letter case, none of other sites."""
    from gleanery.functions.urls import host, registrable

    p = _pages(spark, sf_dir).select(F.col("page_id").alias("slug"), registrable(host("url")).alias("site"), "url", "html", F.col("page_id").alias("ord"))
    return contacts.bio_links(p).select(F.col("slug").alias("page_id"), "link")


@query("""
SELECT n_nationkey AS site, bot, CASE WHEN n_regionkey = 0 THEN 'disallow-all' WHEN n_regionkey = 1 AND bot = 'GPTBot' THEN 'disallow-/ with allows' WHEN n_regionkey = 1 THEN 'allow-rules (1)' WHEN n_regionkey = 2 AND bot = 'ClaudeBot' THEN 'partial-disallow (2 rules)' ELSE 'no-specific-rules' END AS signal
FROM nation, (VALUES ('GPTBot'), ('ClaudeBot')) AS b(bot)""")
def robot_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("n_regionkey")
    body = F.when(r == 0, "User-agent: *\nDisallow: /").when(r == 1, "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nAllow: /x").when(r == 2, "# x\nUser-agent: ClaudeBot\nDisallow: /a\nDisallow: /b").when(r == 3, "Sitemap: https://x.example/s.xml").otherwise("")
    robots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"), body.alias("body"))
    return pages.robot_rules(robots, ["GPTBot", "ClaudeBot"]).select("site", "bot", "signal")


@query("SELECT 'r' || n_regionkey || '.example' AS site, 'https://r' || n_regionkey || '.example/team/' || s_suppkey AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are sites whose sitemap lists a sitemap for each nation, which lists a page for each supplier, one of another site too."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    site = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".example"))
    n = n.select("n_nationkey", site.alias("site"), F.concat(F.lit("https://"), site, F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit(".xml")).alias("map"))
    index = n.groupBy("site").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "map", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body")).select(F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("url"), "body")
    loc = F.concat(F.lit("<url><loc>https://"), "site", F.lit("/team/"), F.col("s_suppkey").cast("string"), F.lit("</loc></url><url><loc>https://other.example/x</loc></url>"))
    leaves = n.join(s, F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("map").alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("body"))
    robots = n.select("site").distinct().select("site", F.concat(F.lit("Sitemap: https://"), "site", F.lit("/sitemap.xml")).alias("body"))
    return pages.frontier(n.select("site", F.concat(F.lit("https://"), "site", F.lit("/none.xml")).alias("url")).distinct(), robots, index.unionByName(leaves)).select("site", "url")


@query("""
WITH p AS (SELECT page_id, url, regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '(?i)/(contact|about|team|our-team|people|staff|attorney|attorneys|bio|bios|lawyer|lawyers|our-firm|meet|leadership|partners?|members?|blog|post|posts|service|services|practice|practices|pricing|faq|case|cases|success|success-stories|case-stud(y|ies))(/|$)') AS wanted,
  regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, lower(regexp_replace(url, '/+$', '')) AS key FROM pages),
f AS (SELECT site, key, min(page_id) AS page_id, any_value(wanted) AS wanted FROM p GROUP BY ALL), r AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY wanted DESC, page_id) AS place FROM f)
SELECT site, page_id, place FROM r WHERE place <= 60""")
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each site as a crawl of at most 60 would meet them."""
    from gleanery.functions.urls import host

    p = table(spark, sf_dir, "pages").select(host("url").alias("site"), "url", "page_id")
    return pages.fetch_order(p, ord_="page_id").select("site", "page_id", F.col("place").cast("long").alias("place"))


@query("""
WITH RECURSIVE p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS slug, page_id, url LIKE 'https:%' AS landed, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) - 1 AS r FROM pages),
w AS (SELECT slug, r, 1 AS wave, landed FROM p WHERE r = 0 UNION ALL SELECT p.slug, p.r, w.wave + 1, p.landed FROM w JOIN p ON p.slug = w.slug AND (p.r - 1) // 3 = w.r AND p.r > 0 WHERE w.landed AND w.wave < 6)
SELECT slug, page_id, wave FROM w JOIN p USING (slug, r) WHERE p.landed""")
def crawl_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a site that a crawl comes to in six waves, where each links to the next three; those not by https didn't land, nor is seen what only they link to."""
    from gleanery.functions.urls import host, registrable

    p = table(spark, sf_dir, "pages").select(host("url").alias("slug"), "page_id", F.col("url").startswith("https:").alias("landed"))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy("page_id")) - 1)
    at = lambda r: F.concat(F.lit("https://"), F.col("slug"), F.lit("/team/p-"), r.cast("string"))
    links = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.lit('<a href="'), F.lit("/team/p-"), (F.col("r") * 3 + k).cast("string"), F.lit('/">x</a>')))
    landed = p.where("landed").select("slug", F.col("slug").alias("site"), at(F.col("r")).alias("url"), F.array_join(links, " ").alias("html"), F.col("r").alias("ord"), "page_id")
    landed = landed.withColumn("site", registrable("site"))
    start = p.where("r = 0").select("slug", at(F.col("r")).alias("url"), F.lit(0).alias("ord"))
    return pages.waves(start, landed, contacts.bio_links(landed, each=True), most=1_000_000, depth=6).select("slug", "page_id", "wave")


# Captures and archives: events are posts, users archives.


@query("""
SELECT page_id, 'POST' AS method, 'Op' || page_id AS operation, 'Q7' AS query_id, 'accept|cookie|x-foo' AS header_names, 5 AS bytes FROM pages""")
def har_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of captured sessions, with names of headers only."""
    p = table(spark, sf_dir, "pages")
    head = lambda n: F.struct(F.lit(n).alias("name"), F.lit("s3cr3t").alias("value"))
    entry = F.struct(F.struct(F.lit("POST").alias("method"), F.concat(F.lit("https://h.example/i/graphql/Q7/Op"), F.col("page_id").cast("string"), F.lit("?variables=%7B%7D&z=1")).alias("url"), F.array(head("Cookie"), head("X-Foo"), head("Accept"), head("Other")).alias("headers")).alias("request"), F.struct(F.lit(200).alias("status"), F.struct(F.lit("abcde").alias("text")).alias("content")).alias("response"))
    har = p.groupBy(bucket("page_id").alias("capture")).agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entries")).alias("log"))).alias("body"))
    e = documents.har_entries(har)
    op = F.regexp_extract("path", r"/graphql/([^/]+)/([^/?#]+)", 2)
    return e.select(F.regexp_extract(op, r"(\d+)$", 1).cast("long").alias("page_id"), "method", op.alias("operation"), F.regexp_extract("path", r"/graphql/([^/]+)/", 1).alias("query_id"), F.array_join("header_names", "|").alias("header_names"), "bytes")


@query("""
SELECT page_id, 'Op' || page_id AS operation, 'Q7' AS query_id, 'GET' AS method, 'https://h.example/i/graphql/Q7/Op' || page_id AS template, page_id::VARCHAR AS id, 'next' AS cursor, 'accept|cookie' AS header_names FROM pages""")
def request_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured requests as templates, without cursor and header values, and the request of the next page as data."""
    p, none = table(spark, sf_dir, "pages"), F.lit(None).cast("string")
    url = F.concat(F.lit("https://h.example/i/graphql/Q7/Op"), F.col("page_id").cast("string"), F.lit("?variables=%7B%22id%22%3A%22"), F.col("page_id").cast("string"), F.lit("%22%2C%22cursor%22%3A%22old%22%7D&features=%7B%7D"))
    r = p.select(url.alias("url"), none.alias("method"), F.create_map(F.lit("Cookie"), F.lit("s3cr3t"), F.lit("Accept"), F.lit("x")).alias("headers"), none.alias("body"))
    t = imports.next_request(imports.request_template(r).withColumn("cursor", F.lit("next")))
    return t.select(F.regexp_extract("operation", r"(\d+)$", 1).try_cast("long").alias("page_id"), "operation", "query_id", "method", "template", F.col("variables")["id"].alias("id"), F.col("variables")["cursor"].alias("cursor"), F.array_join("header_names", "|").alias("header_names"))


def _post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a user: all events, then the clicks again with other numbers. An error has a page of its own, with status 500, at the end."""
    e = table(spark, sf_dir, "events")
    post = lambda likes, text: F.struct(F.col("event_id").cast("string").alias("rest_id"), F.struct(text.alias("full_text"), F.lit("Mon Jan 01 10:00:00 +0000 2024").alias("created_at"), likes.alias("favorite_count")).alias("legacy"))
    entry = lambda p: F.struct(F.struct(F.struct(F.struct(p.alias("result")).alias("tweet_results")).alias("itemContent")).alias("content"))
    body = lambda p: F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.collect_list(entry(p)).alias("entries"))).alias("instructions")).alias("timeline")).alias("data")))
    cursor = F.lit(',{"content":{"cursorType":"Bottom","value":"c1"}}]}]}}}')
    likes = F.floor("value").cast("long")
    page = lambda df, seq, p, open_: df.groupBy(F.col("user_id").cast("string").alias("archive_id")).agg(body(p).alias("body")).select("archive_id", F.lit(seq).cast("long").alias("seq"), F.lit(200).alias("status"), F.concat(F.regexp_replace("body", r"\]\}\]\}\}\}$", ""), cursor).alias("body") if open_ else F.col("body"))
    first = page(e, 0, post(likes, F.col("event_type")), True)
    again = page(e.where("event_type = 'click'"), 1, post(likes + 1, F.lit("later")), True)
    bad = e.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("archive_id"), F.lit(2).cast("long").alias("seq"), F.lit(500).alias("status"), F.lit("{}").alias("body")).distinct()
    last = page(e, 3, post(likes, F.col("event_type")), False)
    return first.unionByName(again).unionByName(bad).unionByName(last)


@query("SELECT user_id::VARCHAR AS archive_id, event_id::VARCHAR AS id, event_type AS text, floor(value)::BIGINT AS favorite_count, 0 AS first_seq FROM events")
def archive_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of all pages: the first text, the newest numbers."""
    return archive.archived(_post_pages(spark, sf_dir)).select("archive_id", "id", "text", "favorite_count", "first_seq")


@query("""
WITH n AS (SELECT user_id::VARCHAR AS archive_id, count(*) AS a, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)
SELECT archive_id, 0 AS seq, a AS posts, a AS added, 0 AS updated FROM n UNION ALL SELECT archive_id, 1, c, 0, c FROM n WHERE c > 0""")
def archive_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.progress(_post_pages(spark, sf_dir)).where("seq < 2").select("archive_id", "seq", "posts", "added", "updated")


@query("""
SELECT user_id::VARCHAR AS archive_id, CASE WHEN max(event_type = 'error') THEN 'fail' ELSE 'exhausted' END AS stop, CASE WHEN max(event_type = 'error') THEN 2 ELSE 3 END AS seq, count(*) AS posts FROM events GROUP BY 1""")
def archive_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.stopped(_post_pages(spark, sf_dir)).select("archive_id", "stop", "seq", "posts")


@query("SELECT user_id::VARCHAR AS archive_id, event_id::VARCHAR AS id, event_type AS text, floor(value)::BIGINT AS favorite_count FROM events")
def captured_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in captured responses: the first of each id, and none of other operations."""
    p = _post_pages(spark, sf_dir).where("status = 200")
    hits = p.select("archive_id", F.col("seq").alias("ord"), F.concat(F.lit("https://x.example/i/graphql/Q/"), F.when(F.col("seq") == 1, "Other").otherwise("UserTweets")).alias("url"), F.lit("GET").alias("method"), "status", F.lit(None).cast("string").alias("operation"), "body")
    return imports.posts_of_hits(documents.hits(hits)).select("archive_id", "id", "text", "favorite_count")


@query("""
SELECT user_id::VARCHAR AS archive_id, event_id::VARCHAR AS id, 'added' AS change, 0 AS seq, floor(value)::BIGINT AS favorite_count FROM events
UNION ALL SELECT user_id::VARCHAR, event_id::VARCHAR, 'updated', seq, floor(value)::BIGINT + (seq = 1)::BIGINT FROM events, (VALUES (1), (3)) AS s(seq) WHERE event_type = 'click'""")
def archive_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that a stream over the landed pages writes; the pages and its sink lie in the folder that all share."""
    folder = scratch(spark)
    pages_ = _post_pages(spark, sf_dir)
    pages_.write.parquet(f"{folder}/pages")
    stream = archive.streamed(spark.readStream.schema(pages_.schema).parquet(f"{folder}/pages"), "append")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/changes").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/changes").select("archive_id", "id", "change", "seq", "favorite_count")


@query("""
SELECT user_id::VARCHAR AS archive_id, CASE WHEN max(event_type = 'error') THEN 'fail' ELSE 'exhausted' END AS stop, CASE WHEN max(event_type = 'error') THEN 2 ELSE 3 END AS seq, count(*) AS posts, CASE WHEN max(event_type = 'error') THEN 1 ELSE 2 END + max(event_type = 'click')::INT AS pages, count(*) + count(*) FILTER (event_type = 'click') * CASE WHEN max(event_type = 'error') THEN 1 ELSE 2 END AS changes
FROM events GROUP BY 1""")
def archive_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks over streamed pages that know when to stop, run once over the first pages and again, from the checkpoint, over the others."""
    folder, pages_ = scratch(spark), _post_pages(spark, sf_dir)
    for landed in ("seq < 2", "seq >= 2"):
        pages_.where(landed).write.mode("append").parquet(f"{folder}/pages")
        walk = walks.walked(spark.readStream.schema(pages_.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{folder}/pages"), timers=False)
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/walks/batch={n}")
        with walks.small_batches(spark):
            run = walk.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
        run.awaitTermination()
    # A batch that is written again replaces itself.
    found = spark.read.schema(walk.schema).parquet(f"{folder}/walks")
    changes = found.groupBy("archive_id").agg(F.sum(F.size("changes")).alias("changes"))
    return walks.ends(found).join(changes, "archive_id").select("archive_id", "stop", "seq", "posts", "pages", "changes")


@query("""
WITH u AS (SELECT user_id, max(event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT e.user_id::VARCHAR AS archive_id, event_id::VARCHAR AS id, event_type AS text, floor(value)::BIGINT + (failed AND event_type = 'click')::BIGINT AS favorite_count FROM events e JOIN u ON e.user_id = u.user_id""")
def archive_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive as a table that a stream of walks upserts, each batch of it twice."""
    folder, pages_ = scratch(spark), _post_pages(spark, sf_dir)
    schema = spark.createDataFrame([], "archive_id string, id string, text string, favorite_count bigint, seq bigint, pos int").schema
    write = upserts.upserting(f"{folder}/archive", schema, ["archive_id", "id"], ["seq", "pos"])

    def twice(batch: DataFrame, number: int) -> None:
        changes = batch.select("archive_id", "seq", F.explode("changes").alias("c")).select("archive_id", "c.id", "c.text", "c.favorite_count", "seq", "c.pos")
        write(changes, number)
        write(changes, number)

    for landed in ("seq < 2", "seq >= 2"):
        pages_.where(landed).write.mode("append").parquet(f"{folder}/pages")
        walk = walks.walked(spark.readStream.schema(pages_.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{folder}/pages"), timers=False)
        with walks.small_batches(spark):
            run = walk.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
        run.awaitTermination()
    return upserts.current(spark, f"{folder}/archive", schema).select("archive_id", "id", "text", "favorite_count")


# The weekly preparation: suppliers not in debt are law firms with a site, a page and a partner on it.


@query(f"""
WITH f AS (SELECT s_suppkey::VARCHAR AS slug, {_sql_letters("s_suppkey")} AS w FROM supplier WHERE s_acctbal >= 0)
SELECT 'queue' AS part, slug, 'Firm ' || w AS value FROM f UNION ALL SELECT 'contact', slug, 'Dana ' || upper(left(w, 1)) || substr(w, 2) FROM f
UNION ALL SELECT 'shortlist', slug, 'dana.' || w || '@' || w || '.example' FROM f UNION ALL SELECT 'coverage', 'Law', 'COVERED' FROM (SELECT 1) WHERE (SELECT count(*) FROM f) > 0 UNION ALL SELECT DISTINCT 'coverage', 'Roofing', 'NOT COVERED' FROM supplier WHERE s_acctbal < 0""")
def weekly_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumns({"slug": F.col("s_suppkey").cast("string"), "w": letters("s_suppkey"), "none": F.lit(None).cast("string")})
    law, site = F.col("s_acctbal") >= 0, F.concat(F.lit("https://"), "w", F.lit(".example"))
    b = s.select("slug", F.concat(F.lit("Firm "), "w").alias("name"), F.lit("Austin").alias("city"), F.when(law, "Law").otherwise("Roofing").alias("category"), *[F.col("none").alias(x) for x in ("practice", "phone")], F.when(law, site).alias("website"), *[F.col("none").alias(x) for x in ("address", "linkedin_company")], F.lit("prospect").alias("status"), F.lit("Justia").alias("source"), F.col("none").alias("email"))
    person = F.to_json(F.struct(F.lit("Person").alias("@type"), F.concat(F.lit("Dana "), F.initcap("w")).alias("name"), F.lit("Founding Partner").alias("jobTitle"), F.concat(F.lit("dana."), "w", F.lit("@"), "w", F.lit(".example")).alias("email")))
    p = s.select(F.concat(site, F.lit("/")).alias("url"), F.concat(_tag("title", F.concat(F.lit("Firm "), F.col("w"))), _tag("script", person, type="application/ld+json")).alias("html"), F.lit("ok").alias("status"), F.col("s_suppkey").alias("ord"))
    limits = spark.createDataFrame([("Law", True, 1, 0.5, None)], "category string, specialty_required boolean, min_notes int, min_site_fill double, specialty_mode string")
    done = prep.prepare(b, p, limits, "Law")
    parts = (done.queue, "queue", "slug", "name"), (done.contacts, "contact", "slug", "name"), (done.shortlist, "shortlist", "slug", "email"), (done.coverage, "coverage", "category", "verdict")
    out = None
    for df, part, key, value in parts:
        one = df.select(F.lit(part).alias("part"), F.col(key).alias("slug"), F.col(value).alias("value"))
        out = one if out is None else out.union(one)
    return out
