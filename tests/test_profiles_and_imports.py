"""Company facts, official links, second-board details and imports, on invented pages."""

import json

from pyspark.sql import functions as F

from gleanery.functions import board_links as L
from gleanery.functions import urls as U
from gleanery.functions.dom import Dom
from gleanery.operators import boards
from gleanery.operators import imports as I
from gleanery.operators import profiles as P
from gleanery.plans import fixtures

C = "https://www.linkedin.com/company/vale/"
BOARD = f"""<link rel="canonical" href="{C}"><h1>Vale & Co</h1><dl><dt>Website</dt><dd><a href="https://www.linkedin.com/redir/redirect?url=https%3A%2F%2Fwww.vale.example%2F">site</a></dd><dt>Industry</dt><dd>Law</dd><dt>Headquarters</dt><dd>Austin</dd></dl>
<aside><dl><dt>Website</dt><dd><a href="https://other.example">x</a></dd></dl></aside>"""
SITE = f"""<script type="application/ld+json">{json.dumps({"@graph": [{"@type": "Organization", "name": "Vale & Co", "url": "https://vale.example", "sameAs": [C], "review": {"@type": "Organization", "sameAs": "https://www.linkedin.com/company/reviewer"}}]})}</script>
<footer><a href="https://www.linkedin.com/company/vale-two">in</a></footer><section class="testimonials"><a href="https://www.linkedin.com/company/client">LinkedIn</a></section><a href="/about-us#x">About</a><a href="https://www.linkedin.com/company/plain">text</a>"""


def profile(spark, page, url=C, source="linkedin"):
    df = spark.createDataFrame([(page, url, source)], "html string, url string, source string")
    return P.company_profiles(df).first()


def test_company_facts(spark):
    r = profile(spark, BOARD)
    assert (r.company_url, r.display_name, r.hosts, r.industries, r.locations, r.canonical_conflict) == (C, "Vale & Co", ["vale.example"], ["Law"], ["Austin"], False)
    assert r.observed_keys == ["vale and co"] and r.requested_url == C and r.websites == ["https://www.vale.example/"] and r.company_id is None
    assert profile(spark, BOARD + f'<link rel="canonical" href="{C}x">'.replace("vale/x", "other")).canonical_conflict
    org = {"@type": ["Thing", "http://schema.org/LegalService"], "name": "Vale Trial", "legalName": "Vale & Co LLC", "sameAs": [C, "https://vale.example/"], "address": {"city": "Austin"}}
    ld = lambda *x: f'<script type="application/ld+json">{json.dumps(list(x))}</script>'
    r = profile(spark, "<h1>Vale Careers and Employment</h1>" + ld({"@type": "Review", "author": org}) + ld({"mainEntity": org}, {"@type": "Organization", "name": "Other", "url": "https://other.example"}))
    assert (r.display_name, r.observed_keys, r.hosts, r.locations) == ("Vale", ["vale", "vale trial", "vale and co llc"], ["vale.example"], ['{"city": "Austin"}'])
    r = profile(spark, ld(org) + '<a href="https://www.vale.example/x">Visit website</a><a aria-label="Vale Trial website" href="https://two.example">w</a><a data-testid="a-companyInfo-companyLink" href="https://three.example">w</a><aside><a href="https://no.example">Website</a></aside><a href="https://www.linkedin.com/jobs/search?f_C=7">See jobs</a>')
    assert r.hosts == ["three.example", "two.example", "vale.example"] and r.display_name == "Vale Trial" and r.company_id == "7"
    r = profile(spark, "", "https://www.indeed.com/cmp/Vale", "indeed")
    assert (r.requested_url, r.company_url, r.display_name, r.hosts) == ("https://www.indeed.com/cmp/vale", "https://www.indeed.com/cmp/vale", "", [])


def test_official_links(spark):
    df = spark.createDataFrame([(SITE, "https://vale.example/", "linkedin", "vale.example", ["vale and co"])], "html string, url string, source string, official_host string, names array<string>")
    r = P.official_candidates(df).first()
    assert {(x.company_url, x.kind) for x in r.found} == {(C, "official_same_as"), ("https://www.linkedin.com/company/vale-two/", "official_link")}
    assert r.pages == ["https://vale.example/about-us"]


def test_hosts_and_links(spark):
    assert [L.site_host(x) for x in ("https://www.Vale.example/x", "https://sites.google.com/x", "http://10.1.2.3", "https://vale.example:8443", "ftp://a.b", None)] == ["vale.example", "", "", "", "", ""]
    apply = "https://www.linkedin.com/jobs/view/externalApply?"
    want = {apply + "jobId=7&url=https%3A%2F%2Fats.example%2Fa": "https://ats.example/a", apply + "url=https%3A%2F%2Fats.example%2Fb": "https://ats.example/b", apply + "jobId=8&url=https%3A%2F%2Fats.example": "", apply + "jobId=7&url=https%3A%2F%2Fats.example&url=x": "", "https://ats.example/x": "https://ats.example/x", C: "", "https://www.linkedin.com/jobs/view/1234567": "", "https://www.linkedin.com/feed": "", "mailto:a@b.example": "", None: ""}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", P.application_link(F.col("x"), F.lit("7")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == want


def test_company_addresses(spark):
    good = {f"{C}": "vale", f" {C} ": "vale", "https://de.linkedin.com/company/Vale-Co/jobs/": "vale-co", "https://linkedin.com/company/vale/jobs": "vale", "https://www.linkedin.com:443/company/vale?x=1#y": "vale"}
    bad = [C + "posts", "https://www.linkedin.com/company/a%20b/", "http://www.linkedin.com/company/vale", "https://www.linkedin.com.evil.example/company/vale", "https://u:p@www.linkedin.com/company/vale", "https://www.linkedin.com:8443/company/vale", "https://www.linkedin.com/company/", "https://www.linkedin.com/company/a b", "", None]
    for x, name in good.items():
        assert L.company_of(x) == f"https://www.linkedin.com/company/{name}/", x
    assert [x for x in bad if L.company_of(x)] == []
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string").select("x", U.board_url("x").alias("u"))
    assert {r.x: r.u for r in df.collect() if r.u} == {x: L.company_of(x) for x in good}
    # Only links of the board itself tell a company's number.
    assert L.company_number("https://www.linkedin.com/jobs/search?f_C=42") == "42" and L.company_number("/jobs/?f_C=42") == "42"
    assert [L.company_number(x) for x in ("https://evil.example/jobs/?f_C=42", "https://de.linkedin.com/jobs/?f_C=42", "/jobs/?f_C=4&f_C=2", "/jobs/?f_C=x", "/x?f_C=1")] == [""] * 5


KEY = "0123456789abcdef"
DETAIL = f"""<link rel="canonical" href="https://www.indeed.com/viewjob?jk={KEY}"><h1 class="jobsearch-JobInfoHeader-title">Cook</h1><div data-testid="inlineHeader-companyName"><a href="https://www.indeed.com/cmp/Vale">Vale</a></div>
<div id="jobDescriptionText"><p>Cook food</p></div><div id="salaryInfoAndJobType">$20 an hour</div><a id="applyButtonLink" href="https://ats.example/1">Apply</a>
<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "url": f"https://www.indeed.com/viewjob?jk={KEY}", "validThrough": "2024-02-01", "baseSalary": {"value": 20}, "employmentType": "FULL_TIME"})}</script>"""


def test_second_details(spark):
    asked = {"own": (DETAIL, KEY, None, "2024-01-15T00:00:00"), "late": (DETAIL, KEY, None, "2024-02-02T00:00:00"), "job": (DETAIL, "f" * 16, None, "2024-01-01T00:00:00"), "firm": (DETAIL, KEY, "https://www.indeed.com/cmp/other", "2024-01-01T00:00:00"), "wall": ("<title>Just a moment...</title>", KEY, None, "2024-01-01T00:00:00"), "none": ("<p>x</p>", KEY, None, "2024-01-01T00:00:00")}
    rows = spark.createDataFrame([(k, h, j, "Vale", c, n) for k, (h, j, c, n) in asked.items()], "k string, html string, job_id string, firm string, company string, now string")
    got = {r.k: r for r in boards.second_job_details(rows).collect()}
    assert {k: r.detail_status for k, r in got.items()} == {"own": "ok", "late": "ok", "job": "job_mismatch", "firm": "company_mismatch", "wall": "blocked", "none": "parse_error"}
    d = got["own"]
    assert (d.title, d.description, d.pay_text, d.pay_basis, d.listing_status, d.apply_url, d.employment_type) == ("Cook", "Cook food", "$20 an hour", "base_salary", "observed", "https://ats.example/1", "FULL_TIME")
    assert got["late"].listing_status == "closed"
    page = f'<script type="application/json">{json.dumps({"a": [{"jobkey": KEY, "title": "T", "company": {"name": "V"}}, {"jk": "no", "title": "x"}]})}</script><script>window._initialData = {json.dumps({"jk": "f" * 16, "jobTitle": "U"})}; more()</script>'
    assert [(x["job_id"], x["title"], x["company"]) for x in P.embedded(Dom(page))] == [(KEY, "T", "V"), ("f" * 16, "U", "")]


def test_imports(spark):
    schema = "slug string, path string, linkedin_company string, owner string, contacts array<struct<name:string,title:string,email:string,profile_url:string>>"
    rows = spark.createDataFrame([("a", None, C, "Olive Own", [("Dana Vale", "Owner", "dana@vale.example", None), ("LinkedIn Member", "Cook", None, None), ("Member", None, None, None)]), (None, "Businesses/b.md", None, None, []), ("a", "x/b.md", None, None, []), ("z", None, None, None, []), ("c", None, C, None, [("", None, None, None)]), ("d", "../d.md", None, None, [])], schema)
    notes = spark.createDataFrame([("a", "a.md"), ("b", "b.md"), ("c", "c.md"), ("d", "d.md")], "slug string, path string")
    good, errors, stats = I.applied(rows, notes)
    assert sorted(r.slug for r in good.collect()) == ["a", "b"]
    assert sorted(r.error for r in errors.collect()) == ["contact without name", "note not found", "path and slug differ", "path leaves the folder"]
    assert {r.outcome: r.n for r in stats.collect()} == {"applied": 2, "error": 4}
    s = {r.slug: r for r in I.board_states(rows.where("slug in ('a', 'z')  and path is null")).collect()}
    assert (s["a"].status, s["a"].contacts_named, s["a"].contacts_masked, s["z"].status) == ("linked", 2, 2, "not_linked_yet")
    people = I.board_contacts(rows.where("slug = 'a' and path is null")).orderBy("ord").collect()
    assert [(p.name, p.title, p.source_pages) for p in people] == [("Dana Vale", "Owner", [C]), (None, "Cook", [C]), ("Olive Own", "Owner", [C])]
    assert rows.where("slug = 'a' and path is null").select(I.owner(F.col("contacts"), F.lit(None).cast("string"))).first()[0] == "Dana Vale"
    c = spark.createDataFrame([(("A  B", "p", "u"),)], "c struct<name:string,pfp:string,url:string>").select(I.one_contact(F.col("c"), ["name", "pfp", "url"]).alias("c")).first().c
    assert (c.name, c.photo_url, c.profile_url, c.email) == ("A B", "p", "u", "")


def test_small_functions(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("see https://www.yelp.com/x and https://b.example). candidate_website: https://a.example/; https://b.example", I.candidate_urls) == ["https://a.example/", "https://b.example"]
    assert one("a b&c", I.search_url) == "https://x.com/search?q=a%20b%26c&src=typed_query&f=live"
    req = spark.createDataFrame([('https://h.example/i/graphql/Q1/UserTweets?variables=%7B%22id%22%3A%221%22%2C%22cursor%22%3A%22z%22%7D&features=%7B%22f%22%3Atrue%7D', "get", {"Cookie": "secret", "Accept": "x"}, None)], "url string, method string, headers map<string,string>, body string")
    t = I.request_template(req)
    r = t.first()
    assert (r.operation, r.query_id, r.method, r.template, r.variables, r.header_names) == ("UserTweets", "Q1", "GET", "https://h.example/i/graphql/Q1/UserTweets", {"id": "1"}, ["accept", "cookie"])
    assert I.next_request(t.withColumn("cursor", F.lit("c2"))).first().variables == {"id": "1", "cursor": "c2"}
    hits = spark.createDataFrame([("a", 0, "UserTweets", fixtures.timeline([fixtures.post("1", "x", 1)], None)), ("a", 1, "Other", fixtures.timeline([fixtures.post("2", "y", 1)], None)), ("a", 2, "UserTweets", fixtures.timeline([fixtures.post("1", "later", 5)], None))], "archive_id string, ord long, operation string, body string")
    assert [(p.id, p.text, p.favorite_count) for p in I.posts_of_hits(hits).collect()] == [("1", "x", 1)]
    want = spark.createDataFrame([(1, "Vale Trial", "+1 512 555 0133"), (2, "ACME LAW", "512-555-0133"), (3, "Birch Roofing LLC", None), (4, "Nobody", None)], "i int, name string, phone string")
    assert {r.i: r.slug for r in I.found_business(want, fixtures.businesses(spark)).collect()} == {1: "acme-law", 2: "acme-law", 3: "birch", 4: None}


def test_classifiers_of_rows(spark):
    from gleanery.operators import filters as K
    from gleanery.operators import ranking

    each = lambda vs, f: [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, x string").select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]
    assert each(["a/.git/x", "b.md", "c.tmp", "~$d.docx", "e.md~", ".DS_Store", "gita/x"], K.skipped_file) == [True, False, True, True, True, True, False]
    assert each(["https://x.com/login", "https://x.com/account/access", "https://x.com/a"], lambda u: K.page_status(u, F.lit("t"), F.lit("b"))) == ["wall", "soft_block", "ok"]
    assert each(["Rate limit exceeded", "fine"], lambda b: K.page_status(F.lit("https://x.com/a"), F.lit(""), b)) == ["soft_block", "ok"]
    assert each(["https://a.b/careers", "https://a.b/privacy/", "https://a.b/mycareers"], K.is_careers_page) == [True, True, False]
    assert each(["https://a.b/our-team", "https://a.b/x"], K.is_people_page) == [True, False]
    assert each(["[[Law]]", "Law", "Lawn", None], lambda c: K.in_category(c, "Law")) == [True, True, False, False]
    assert each(["Law", None, "Roofing"], lambda c: K.category_fits(c, "law")) == [True, True, False] and each(["x"], lambda c: K.category_fits(c, "*")) == [True]
    assert each(["", "LinkedIn Member", "Dana"], K.is_masked) == [True, True, False]
    assert each(["## Contacts\n- a", "## Contacts\n\n## Other\n- b", None], K.has_contacts) == [True, False, False]
    phones = spark.createDataFrame([("s", "+1-800-555-0100", "u0", False, False, True, 0), ("s", "+1-512-555-0101", "u1", True, True, False, 1), ("s", "+1-512-555-0102", "u2", False, True, True, 2)], "slug string, phone string, source_url string, is_bio boolean, mentions_poc boolean, contactish boolean, ord int")
    assert ranking.firm_phone(phones, ["512"]).first().phone == "+1-512-555-0102" and ranking.firm_phone(phones, []).first().phone == "+1-800-555-0100"
    assert ranking.poc_phone(phones).first().phone == "+1-512-555-0101"
    urls = spark.createDataFrame([("s", "https://a.b/zzz"), ("s", "https://a.b/contact"), ("s", "https://a.b/")], "site string, url string")
    assert [r.url for r in ranking.prioritized(urls, "site", 2).orderBy("place").collect()] == ["https://a.b/", "https://a.b/contact"]
