"""The remaining operators, one small case each."""

from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import text as X
from gleanery.operators import contacts as C
from gleanery.operators import dedup, entities, filters, hiring, identity, merge, metrics, pages, ranking
from gleanery.plans import fixtures, prep
from gleanery.sources import directories, documents, schemas, sinks


def test_sites_and_queue(spark):
    b = fixtures.businesses(spark)
    c = spark.createDataFrame([("birch", "https://www.yelp.com/b", 0), ("birch", "https://no.example", 1), ("birch", "https://birch.example/home", 2), ("vale", "https://x.example", 3)], "slug string, url string, ord int")
    p = spark.createDataFrame([("https://no.example", "https://no.example", 200, "something else"), ("https://birch.example/home", "https://birch.example/home", 200, "Birch Roofing of Waco")], "url string, final_url string, http_code int, text string")
    assert [(r.slug, r.website) for r in entities.website_matches(b, c, p).collect()] == [("birch", "https://birch.example")]
    prof = spark.createDataFrame([("birch", "https://p.example", "https://www.linkedin.com/company/birch/")], "slug string, website string, linkedin_company string")
    q = {r.slug: r for r in entities.queue(b, prof).collect()}
    assert q["birch"].website == "https://p.example" and q["vale"].website == "https://vale.example" and q["birch"].linkedin_company.endswith("birch/")
    known = spark.createDataFrame([("vale", "https://vale.example/contact/", 0), ("vale", "https://vale.example/people/lee", 1), ("vale", "https://other.example/x", 2)], "slug string, url string, ord int")
    s = [r.url for r in pages.seeds(b.where("slug = 'vale'"), known).orderBy("ord").collect()]
    assert s[0] == "https://vale.example/" and s[-1] == "https://vale.example/people/lee" and len(s) == len(pages.COMMON_PATHS) + 1
    assert [r.slug for r in filters.selected(b, from_slug="l").orderBy("slug").collect()] == ["lawn", "vale"] and filters.selected(b, "Law", limit=1).count() == 1
    def slugs(rows, taken):
        df = entities.unique_slugs(spark.createDataFrame(rows, "base string, o int"), "base", ["o"], spark.createDataFrame([(t,) for t in taken], "slug string"))
        return [r.unique_slug for r in df.orderBy("o").collect()]

    assert slugs([("a", 0), ("a", 1)], ["a", "a-2"]) == ["a-3", "a-4"]
    assert slugs([("acme", 0), ("acme", 1), ("acme-2", 2)], []) == ["acme", "acme-2", "acme-2-2"]
    assert slugs([("acme-2", 0), ("acme", 1), ("acme", 2), (None, 3), ("b", 4)], []) == ["acme-2", "acme", "acme-3", None, "b"]
    assert slugs([("acme", 0), ("acme", 1)], ["acme", "acme-3"]) == ["acme-2", "acme-4"]


def test_profiles_and_pages(spark):
    k = spark.createDataFrame([("s", "https://a.b/about", "ok", "A", 1), ("s", "https://a.b/contact-us", "ok", "C", 2), ("s", "https://a.b/contact", "ok", "C2", 3), ("s", "https://a.b/team", "error", "T", 0)], "slug string, url string, status string, title string, ord int")
    assert [(r.label, r.title) for r in ranking.key_pages(k, "slug", prep.KEY_PAGES).orderBy("place").collect()] == [("contact", "C"), ("about", "A")]
    profile = spark.createDataFrame([("s", 5, "u", None), ("t", 9, "v", "old")], "slug string, best_poc_score int, best_poc_url string, linkedin_company string")
    rows = spark.createDataFrame([("s", 5, "new", "c"), ("t", 3, "worse", None)], "slug string, poc_score int, profile_url string, linkedin_company string")
    got = {r.slug: r for r in prep.merged_profile(profile, rows).collect()}
    assert (got["s"].best_poc_url, got["s"].linkedin_company, got["t"].best_poc_url, got["t"].linkedin_company) == ("new", "c", "v", "old")
    bots = spark.createDataFrame([([("B", "partial-disallow (1 rules)", ["/wp-admin/"]), ("A", "disallow-all", ["/", "/x"])],)], "b array<struct<bot:string,signal:string,disallows:array<string>>>")
    assert [x.bot for x in bots.select(prep.compacted_bots(F.col("b"))).first()[0]] == ["A"]
    assert [r.rows for r in prep.doctor({"b": fixtures.businesses(spark), "a": k}).collect()] == [4, 5]
    t = spark.createDataFrame([(["Trial (3)", "the (2)", "ab", "Team"],)], "t array<string>")
    assert t.select(X.theme_words("t")).first()[0] == ["Trial", "Team"]
    probe = spark.createDataFrame([("# hi", "ok"), ("<!DOCTYPE html>", "ok"), ("x", "error")], "b string, s string")
    assert [r[0].present for r in probe.select(H.llms_probe("b", "s")).collect()] == [True, False, False]
    filled = C.filled_phones(fixtures.contacts(spark), spark.createDataFrame([("f", "DANA VALE", "+1-512-555-0199")], "slug string, name string, phone string"))
    assert {r.phone for r in filled.where("lower(name) = 'dana vale'").collect()} == {"+1-512-555-0199"}


def test_identity_and_hiring_parts(spark):
    contacts = spark.createDataFrame([("s", "linkedin", "A"), ("s", "website", "B"), ("t", "linkedin", "C")], "slug string, source string, name string")
    keep, out = identity.retired(contacts, spark.createDataFrame([("s", False), ("t", True)], "slug string, same boolean"))
    assert sorted(r.name for r in keep.collect()) == ["B", "C"] and [r.name for r in out.collect()] == ["A"]
    jobs = spark.createDataFrame([([("1", "https://www.linkedin.com/company/vale/"), ("2", "https://www.linkedin.com/company/other/"), ("3", None)],)], "j array<struct<id:string,company_url:string>>")
    s = jobs.select(identity.split_jobs(F.col("j"), F.array(F.lit("https://www.linkedin.com/company/vale/")), F.lit("linkedin")).alias("s")).first().s
    assert [j.id for j in s.good] == ["1"] and [j.id for j in s.bad] == ["2", "3"]
    new = spark.createDataFrame([("s", "b", "1", None), ("s", "b", "2", "now")], "slug string, board string, job_id string, description string")
    old = spark.createDataFrame([("s", "b", "1", "before"), ("s", "b", "2", "older")], "slug string, board string, job_id string, description string")
    assert {r.job_id: r.last_successful_description for r in hiring.carried_details(new, old).collect()} == {"1": "before", "2": None}
    tries = spark.createDataFrame([("j", 0, None, "x", "partial"), ("j", 1, "text", None, "ok"), ("j", 2, None, None, "blocked"), ("k", 0, None, None, "a"), ("k", 1, None, "y", "b")], "id string, n int, description string, pay string, status string")
    d = {r.id: r for r in hiring.detail_attempts(tries, ["id"], "n").collect()}
    assert (d["j"].status, d["j"].description, d["j"].pay, d["j"].attempts, d["k"].status) == ("ok", "text", "x", 3, "b")
    det = spark.createDataFrame([("s", "ok", "d", "closed"), ("s", "partial", "", "closed"), ("t", "ok", "d", "observed")], "slug string, detail_status string, description string, listing_status string")
    m = {r.slug: r for r in metrics.detail_counts(det, ["slug"]).collect()}
    assert (m["s"].status, m["s"].closed, m["s"].descriptions, m["t"].status) == ("unknown", 2, 1, "hiring")
    assert spark.range(1).select(hiring.unknown_hiring(F.lit("why")).alias("h")).first().h.is_hiring is None


def test_metrics_and_merges(spark):
    e = spark.createDataFrame([("GET", "/a", 5, "t1"), ("GET", "/a", 9, "t2"), ("POST", "/b", 1, "t3")], "method string, path string, bytes int, template string")
    assert [(r.path, r.n) for r in metrics.request_counts(e).collect()] == [("/a", 2), ("/b", 1)] and [r.bytes for r in metrics.large_responses(e, 2).collect()] == [9, 5]
    h = spark.createDataFrame([("Op", 1, "u1"), ("Op", 0, "u0"), ("X", 2, "u2")], "operation string, ord int, url string")
    assert [(r.operation, r.n, r.sample.url) for r in metrics.operation_counts(h).collect()] == [("Op", 2, "u0"), ("X", 1, "u2")]
    assert metrics.samples(h, "operation", ["ord"], 1).count() == 2
    assert metrics.fill_counts(fixtures.businesses(spark), ["phone", "website"]).first().asDict() == {"total": 5, "with_phone": 1, "with_website": 3}
    assert [metrics.exit_code(spark.createDataFrame([(s,)], "status string")).first().exit_code for s in ("ok", "error")] == [0, 2]
    p = spark.createDataFrame([("s", ["A", "B"]), ("s", ["B"])], "site string, schema_types array<string>")
    assert [r.type for r in metrics.schema_types(p, "site").orderBy("place").collect()] == ["B", "A"]
    t = spark.createDataFrame([("a", "Late", 200, 0), ("a", "Want", 500, 1), ("a", "Want", 200, 2), ("a", "Want", 200, 3)], "archive_id string, operation string, status int, ord int")
    assert ranking.timeline_page(t, ["Want", "Late"]).first().ord == 3
    runs = spark.createDataFrame([("s", "research-s-1.json", 1), ("s", "research-s-2.json", 2)], "slug string, file string, n int")
    assert documents.latest_runs(runs).first().n == 2 and documents.latest_runs(runs, spark.createDataFrame([("s", "research-s-1.json")], "slug string, file string")).first().n == 1
    assert dedup.latest_by(runs, ["slug"], ["file"]).first().n == 2
    fix = merge.corrected(spark.createDataFrame([("s", "bad.example"), ("t", "bad.example")], "slug string, site string"), spark.createDataFrame([("s",)], "slug string"), ["slug"], "site")
    assert {r.slug: r.site for r in fix.collect()} == {"s": None, "t": "bad.example"}
    assert spark.createDataFrame([(["a"], ["a", "b"])], "o array<string>, n array<string>").select(merge.section_bullets(F.col("o"), F.col("n"))).first()[0] == ["a", "b"]
    old = spark.createDataFrame([("1", "", "", 3)], "id string, text string, created_at string, favorite_count int")
    new = spark.createDataFrame([("1", "x", "t", 3), ("2", "y", "t", 1)], "id string, text string, created_at string, favorite_count int")
    assert {r.id: (r.text, r.change) for r in merge.upsert_posts(old, new, ["id"]).collect()} == {"1": ("x", "updated"), "2": ("y", "added")}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "sources.json").write_text('{"sources": {"r1": {"kind": "soda", "url": "u", "params": {"$limit": "5"}, "parse": ["trec"]}, "r2": {"kind": "csv", "url": "v"}}}')
    reg = directories.registry(spark.read.schema(schemas.REGISTRY).json(str(tmp_path / "sources.json"), multiLine=True))
    assert {r.recipe: (r.kind, r.parse) for r in reg.collect()} == {"r1": ("soda", ["trec"]), "r2": ("csv", None)}
    (tmp_path / "coverage.json").write_text('{"rows": [{"category": "Law", "min_notes": 80, "min_site_fill": 0.25}]}')
    assert documents.thresholds(spark, str(tmp_path / "coverage.json")).first().min_notes == 80
    (tmp_path / "firms").mkdir()
    (tmp_path / "firms" / "a.json").write_text('{"slug": "a", "category": "Law"}')
    (tmp_path / "firms" / "_index.json").write_text('{"slug": "index"}')
    (tmp_path / "firms" / "b.json").write_text("{broken")
    assert [r.slug for r in documents.profiles(spark, str(tmp_path / "firms"), "slug string, category string", "law").collect()] == ["a"]
    prof = spark.createDataFrame([("https://dir.example/ann/contact?x", '<a data-vars-action="ProfileWebsite" href="https://ann.example/?u=1">')], "url string, html string")
    cands = spark.createDataFrame([("A", "https://dir.example/ann", ""), ("B", "", "")], "firm string, profile_url string, candidate_website string")
    assert {r.firm: r.candidate_website for r in directories.profile_websites(cands, prof).collect()} == {"A": "https://ann.example/", "B": ""}
    rec = pages.records(fixtures.pages(spark).where("html is not null").withColumn("page_id", F.col("ord")))
    assert "## Vale Trial Group" in sinks.site_digest(rec).where("url = 'https://vale.example/'").first().markdown
    stats = metrics.digest(spark.createDataFrame([("a", "one two three four five"), ("a", "one two three four six")], "archive string, text string"), "archive")
    op = metrics.openers(spark.createDataFrame([("a", "one two three four five"), ("a", "one two three four six")], "archive string, text string"), "archive")
    assert sinks.archive_digest(stats, op, "archive").first().markdown == "# a\n\nposts: 2, median: 22, mean: 22\n\n- one two three four (2)"
    assert sinks.run_report(spark.createDataFrame([("ok", "a"), ("ok", "b")], "status string, slug string"), "status", "slug").first().samples == ["a", "b"]
    sinks.write_json(stats, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    hits = spark.createDataFrame([("c", 0, "https://h.example/i/graphql/Q/Op?x", "GET", 200, None, "abc")], "capture string, ord int, url string, method string, status int, operation string, body string")
    assert documents.hits(hits).first().operation == "Op"
    assert spark.range(1).select(documents.contact_bullet(F.lit("A"), F.lit(""), F.lit("e@x"), F.lit(None).cast("string"))).first()[0] == "- A — e@x"
    assert spark.range(1).select(X.stamp(F.lit("2024-01-01 03:00:00").cast("timestamp"))).first()[0] == "2023-12-31"
    ph = spark.createDataFrame([(["18005550100", "512 555 0101"],)], "p array<string>")
    assert ph.select(X.preferred_phone("p", ["512"]), X.preferred_phone("p", [])).first() == ("+1-512-555-0101", "+1-800-555-0100")
    assert spark.createDataFrame([("@dana_v",), ("a-b",)], "h string").select(X.handle("h")).collect() == [("dana_v",), (None,)]
    assert spark.createDataFrame([("3.9",), ("x",)], "h string").select(X.lenient_int("h")).collect() == [(3,), (None,)]


def test_sitemaps_in_the_order_met(spark):
    from gleanery.operators import pages

    site = "https://a.example"
    nested = lambda *x: "<sitemapindex>" + "".join(f"<sitemap><loc>{site}/{u}.xml</loc></sitemap>" for u in x) + "</sitemapindex>"
    maps = [(f"{site}/sitemap.xml", nested("z1", "a1")), (f"{site}/z1.xml", nested("deep1"))] + [(f"{site}/deep{i}.xml", nested(f"deep{i + 1}", "z1").replace("</sitemapindex>", f"<url><loc>{site}/p{i}</loc></url></sitemapindex>")) for i in range(1, 9)]
    maps = [(u, b if "<url>" not in b else b) for u, b in maps] + [(f"{site}/a1.xml", f"<urlset><url><loc>{site}/last</loc></url></urlset>")]
    maps += [(f"{site}/only{i}.xml", f"<urlset><url><loc>{site}/o{i}</loc></url></urlset>") for i in range(1, 9)]
    start = spark.createDataFrame([("a.example", f"{site}/sitemap.xml")], "site string, url string")
    robots = spark.createDataFrame([("a.example", f"Sitemap: {site}/only3.xml\nSitemap: {site}/only1.xml")], "site string, body string")
    df = spark.createDataFrame(maps, "url string, body string")
    got = lambda most: sorted(r.url.removeprefix(site) for r in pages.frontier(start, robots, df, most).collect())
    # Two of robots, then the one tried anyway, z1 and a1 in their order, then deeper ones, to any depth.
    assert got(1) == ["/o3"] and got(2) == ["/o1", "/o3"] and got(4) == ["/o1", "/o3"] and got(5) == ["/last", "/o1", "/o3"]
    assert {"/last", "/o1", "/o3"} <= set(got(25)) and len(got(25)) >= 3
    landed = spark.createDataFrame([("a.example", f"{site}/zzz", 0), ("a.example", f"{site}/contact", 1), ("a.example", f"{site}/CONTACT/", 2), ("a.example", f"{site}/b", 3)], "site string, url string, ord int")
    assert [r.url for r in pages.fetch_order(landed, most=2).orderBy("place").collect()] == [f"{site}/contact", f"{site}/zzz"]
