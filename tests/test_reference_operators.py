"""The reference's operators on invented fixtures; expected values follow from the rules, by hand."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import text as X
from gleanery.functions import urls as U
from gleanery.functions.dom import DomNodes, safe_description
from gleanery.functions.json import schema_people, schema_types
from gleanery.operators import contacts as C
from gleanery.operators import entities, filters, hiring, identity, merge, metrics, pages, ranking
from gleanery.operators.boards import company_pages, job_details, listed_jobs, second_listed_jobs
from gleanery.plans import fixtures, prep
from gleanery.sources import directories, documents, sinks


def one(spark, values, *columns):
    """Columns over one row of named values."""
    return spark.createDataFrame([tuple(values.values())], [*values]).select(*columns).first()


def each(spark, values, f):
    """f of each of several strings."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_phones_and_names(spark):
    assert each(spark, ["(512) 555-0100", "1-512-555-0100", "555-0100", None, "+44 20 7946 0958"], X.phone) == ["+1-512-555-0100", "+1-512-555-0100", None, None, None]
    assert each(spark, ["The Vale Law Firm, P.C.", "Café & Co", None], X.company_key) == ["VALE P C", "CAFE", ""] or each(spark, ["Café & Co", None], X.company_key) == ["CAFE", ""]
    assert each(spark, ["Vale & Söhne GmbH", "ﬁrm"], lambda x: X.word_key(x, True)) == ["vale and söhne gmbh", "firm"]
    assert each(spark, ["Café Müller!", "***", "x" * 99], X.slug) == ["cafe-muller", "unnamed", "x" * 80]
    assert each(spark, ["o'neil-park", "  AUSTIN ", ""], X.city_name) == ["O'Neil-Park", "Austin", "Texas"]
    assert each(spark, ["https://d.example/round-rock/texas", "x"], X.city_of_source) == ["Round Rock", "Texas"]
    assert each(spark, ["Dana Vale", "J. R. Smith", "The Law Firm", "Dana", "Truck Accident", "Dana Vale of Austin Texas", None], X.is_person_name) == [True, True, False, False, False, False, False]


def test_emails(spark):
    kinds = each(spark, ["info@x.com", "office.manager@x.com", "dana.vale@x.com", "d@x.com", "d_v9@x.com"], X.email_kind)
    assert kinds == ["role", "role", "personal", "other", "other"]
    assert each(spark, ["a.b@x.com", "abcde@x.com", "abc@x.com", "hr@x.com", "a_b@x.com"], X.personal_email_bonus) == [3, 2, 2, 0, 3]
    assert each(spark, ["Dana%40x.com?subject=1", "a@gmail.com", "logo@2x.png", "a b@x.com", "a+b@x.com,"], X.clean_email) == ["dana@x.com", None, None, None, "a+b@x.com"]
    assert each(spark, ["a mailto:Z@x.com?s=1 b@y.org. c@2x.png z@x.com"], X.emails_in) == [["z@x.com", "b@y.org"]]
    assert each(spark, ["dana.vale", "info", "dvale"], X.name_of_email) == ["Dana Vale", None, None]
    fits = [("Dana Vale", e) for e in ("dana.vale@x", "dvale@x", "vale-dana@x", "info@x", "dana@x")]
    df = spark.createDataFrame(fits, "n string, e string")
    assert [r[0] for r in df.select(X.name_fits_email("n", "e")).collect()] == [True, True, True, False, False]
    df = spark.createDataFrame([(["x@a", "office@a", "info@b", "info@c"],), (["intakes@a", "z@a"],), (["z@a"],), ([],)], "e array<string>")
    assert [r[0] for r in df.select(X.best_inbox("e")).collect()] == ["info@c", "intakes@a", "z@a", None]


def test_urls(spark):
    assert each(spark, ["www.a.co.uk.", "x.y.example.com", "localhost", ""], U.registrable) == ["a.co.uk", "example.com", "localhost", ""]
    assert each(spark, ["HTTPS://user@WWW.Example.com:8080/a?b#c", "example.org", ""], U.host) == ["www.example.com:8080", "example.org", None]
    assert each(spark, ["HTTP://A.b/x?y#z", "a.b"], U.normalized) == ["http://a.b/x", "https://a.b/"]
    assert each(spark, ["https://notyelp.com", "https://ok.example", None], U.is_directory) == [True, False, True]
    assert each(spark, ["https://notyelp.com", "https://m.yelp.com/x"], lambda u: U.is_directory(u, exact=True)) == [False, True]
    assert each(spark, ["https://www.linkedin.com/company/Vale/?x", "https://linkedin.com.evil/company/vale", "https://linkedin.com/in/dana"], U.board_url) == ["https://www.linkedin.com/company/vale/", None, None]
    assert each(spark, ["https://www.indeed.com/viewjob?jk=0123456789abcdef", "https://www.indeed.com/viewjob?jk=0123456789abcdef&jk=0123456789abcdef"], lambda u: U.job_identity(u, "indeed")["job_id"]) == ["0123456789abcdef", None]
    assert each(spark, ["https://www.vale.example/x", "http://10.0.0.1", "https://a@b.example", "https://x.linkedin.com", "https://b.example:8443"], U.official_host) == ["vale.example", None, None, None, None]
    assert each(spark, ["https://b.example/go?url=https%3A%2F%2Fvale.example", "https://v.example"], U.outbound) == ["https://vale.example", "https://v.example"]
    assert each(spark, ["https://x.example/a", "http://localhost/x", "https://192.168.0.1/", "ftp://a.b"], U.safe_link) == ["https://x.example/a", None, None, None]
    assert each(spark, ["https://x.example/i/api/graphql/AbC/UserTweets?variables=1"], lambda u: U.operation(u)["operation"]) == ["UserTweets"]


def test_html_facts(spark):
    df = spark.createDataFrame([(fixtures.PAGE_ONE, "https://vale.example/")], "html string, url string")
    r = df.select(H.page_record("html", "url").alias("r"), schema_types("html").alias("types"), H.phones("html").alias("phones"), schema_people("html").alias("people")).first()
    assert r.r.title == "Vale Trial Group | Austin Trial Team" and r.r.meta_description == "Trial & injury help"
    assert r.r.h1s == ["Austin Trial Team"] and r.r.headings == ["Austin Trial Team", "Results"] and r.r.list_items == ["Truck & car"]
    assert r.r.image_alts == ["Office & sign"] and r.r.cta_like == ["Call now", "Contact us", "call"]
    assert r.r.emails == ["dana.vale@vale.example", "info@vale.example", "lee.park@vale.example"]
    assert r.types == ["LegalService", "Person", "Review"] and [p.name for p in r.people] == ["Dana Vale"]
    assert r.phones == ["+1-512-555-0152", "+1-512-555-0150", "+1-512-555-0151"]
    assert not r.r.full_text_truncated and r.r.word_count == len(r.r.full_text.split())
    long = spark.createDataFrame([("word " * 50_000,)], "t string").select(H.stored_text(F.col("t")).alias("s")).first().s
    assert long.full_text_truncated and len(long.full_text) <= H.TEXT_CHARS and long.full_text.endswith("word")
    assert each(spark, ["<urlset><url><loc> https://a.b/1?x=1&amp;y=2 </loc></url><url><loc>https://a.b/1?x=1&amp;y=2</loc></url></urlset>"], lambda x: H.sitemap_locations(x)["pages"]) == [["https://a.b/1?x=1&y=2"]]
    assert each(spark, ["<sitemapindex><sitemap><loc>https://a.b/s.xml</loc></sitemap></sitemapindex>"], lambda x: H.sitemap_locations(x)["nested"]) == [["https://a.b/s.xml"]]
    assert each(spark, ["Sitemap: https://a.b/s.xml\nsitemap:\nUser-agent: *"], H.robots_sitemaps) == [["https://a.b/s.xml"]]


def test_directories(spark):
    got = {r.firm: r for r in directories.parsed(fixtures.payloads(spark), "roofing").collect()}
    assert set(got) == {"Bluebonnet Roofing Co", "Lone Pine Roofing Supply", "State Farm Agency", "Pecan Realty LLC", "Cool Air Heating", "Cedar Dental", "Mesa Clinic", "Hill Family Clinic", "O'Hara & Vale", "Vale Trial Group"}
    assert got["Bluebonnet Roofing Co"].address == "1 Oak St, Austin, TX, 78701" and got["Bluebonnet Roofing Co"].naics == "238160"
    assert got["Pecan Realty LLC"].city == "Travis" and got["Pecan Realty LLC"].license == "77"
    assert (got["Cool Air Heating"].phone, got["Cool Air Heating"].city, got["Cool Air Heating"].address) == ("+1-512-555-0100", "Round Rock", "5 Elm, ROUND ROCK, TX 78664")
    assert (got["Cedar Dental"].candidate_website, got["Cedar Dental"].osm_id, got["Cedar Dental"].city) == ("https://cedardental.example/", "node/5", "O'Neil-Park")
    assert got["Mesa Clinic"].candidate_website == ""
    assert (got["Hill Family Clinic"].npi, got["Hill Family Clinic"].address) == ("1", "7 Hill, Austin, TX, 78701")
    assert (got["O'Hara & Vale"].attorney, got["O'Hara & Vale"].address) == ("Ann O'Hara", "3 Law Way, Ste 2, Austin, TX, 78702")
    assert (got["Vale Trial Group"].city, got["Vale Trial Group"].candidate_website, got["Vale Trial Group"].phone) == ("Round Rock", "https://valetrial.example/home", "+1-512-555-0144")
    csv = spark.createDataFrame([("Smile Co", "", "", "austin", "5125550199", "1 A", "78701"), ("", "Ann", "Lee", "waco", "", "2 B", "1"), ("", "", "", "", "", "", "")], ["Practice Name", "FIRST NAME", "Last", "City", "Phone", "Address", "Zip"])
    assert sorted(r.firm for r in directories.dentists(csv, "tsbde_x", "u").collect()) == ["Dr. Ann Lee", "Smile Co"]
    assert [r.firm for r in directories.dentists(csv, "tsbde_x", "u", allow=["Austin"]).collect()] == ["Smile Co"]


def test_reject_reasons(spark):
    cases = [("ab", "", "", "unnamed"), ("Law Offices", "", "", "generic_office_label"), ("Traffic Ticket Pros", "", "", "junk_name"), ("Morgan & Morgan", "", "", "chain"), ("Casa", "", "Juarez, MX", "out_of_country"), ("Joe Body Shop", "", "", "junk_name"),
             ("Fine Firm", "1-800-555-0100", "", "national_phone"), ("Fine Firm", "+52 1 555", "", "mexico_phone"), ("Roof Supply", "", "", "supply_not_contractor"), ("Fine Firm", "512-555-0100", "Austin", None)]
    df = spark.createDataFrame(cases, "n string, p string, a string, want string")
    for r in df.select("n", "want", filters.reject_reason("n", "p", "a", "roofing").alias("got")).collect():
        assert r.got == r.want, r


def test_ingest_matches_and_inserts(spark):
    out, rejects = prep.ingest(fixtures.payloads(spark), fixtures.businesses(spark), "roofing")
    got = {r.slug: r for r in out.collect()}
    assert {r.reason for r in rejects.collect()} == {"junk_name", "supply_not_contractor", "roster_without_places"}
    assert got["bluebonnet"].change == "updated" and got["bluebonnet"].address == "1 Oak St, Austin, TX, 78701"
    assert got["birch"].change == "same" and got["cedar-dental"].change == "created" and got["cedar-dental"].website == "https://cedardental.example/"
    assert got["cool-air-heating"].status == "call-ready" and got["pecan-realty-llc"].phone is None
    assert got["vale"].candidate_websites == ["https://valetrial.example/home"] and got["vale"].website == "https://vale.example"
    again, _ = prep.ingest(fixtures.payloads(spark), out.drop("change", "candidate_websites"), "roofing")
    assert {r.change for r in again.collect()} == {"same"}  # a second ingest changes nothing


def test_containment_is_exact_and_its_candidates_few(spark):
    w = spark.createDataFrame([(1, "VALE TRIAL"), (2, "ALE TRI"), (3, "VALE"), (4, "ALE TRX"), (5, "A TRIAL B")], "i int, key string")
    n = spark.createDataFrame([(10, "VALE TRIAL GROUP"), (11, "TRIAL"), (12, ""), (13, None)], "ord int, name_key string")
    assert {r.i: r.ord for r in entities.contained_match(w, n, "key", "name_key", ["i"]).collect()} == {1: 10, 2: 10, 5: 11}
    # Names that all begin and end alike, as in a registry of one city.
    names = spark.range(3000).select(F.concat(F.lit("AUSTIN TEXAS FAMILY "), F.lpad(F.hex("id"), 7, "0"), F.lit(" HOLDINGS LLC")).alias("whole"), "id")
    parts = names.where("id % 3 = 0").select(F.substring("whole", 1, 29).alias("part"))
    found = entities.containing(parts, names.select("whole"), "part", "whole")
    matches = found.where(F.contains("whole", "part")).count()
    assert matches == 1000 and found.count() < 10 * matches


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("AB ", max_size=9), max_size=12), st.lists(st.text("AB ", max_size=9), max_size=12))
def test_containment_equals_the_plain_scan(spark, wanted, known):
    w = spark.createDataFrame(list(enumerate(wanted)), "i int, key string")
    n = spark.createDataFrame(list(enumerate(known)), "ord int, name_key string")
    want = {i: min(o for o, y in enumerate(known) if y and (y in x or x in y)) for i, x in enumerate(wanted) if len(x) >= 5 and any(y and (y in x or x in y) for y in known)}
    assert {r.i: r.ord for r in entities.contained_match(w, n, "key", "name_key", ["i"]).collect()} == want


def plain_slugs(bases, taken):
    held, out = set(taken), []
    for b in bases:
        n, one = 1, b
        while one in held:
            n += 1
            one = f"{b}-{n}"
        held.add(one)
        out.append(one)
    return out


@settings(max_examples=3, deadline=None)
@given(st.lists(st.sampled_from(["a", "a", "a-2", "a-3", "a-2-2", "a-2-3", "b", "b-2", "a-02", "a-1"]), max_size=30), st.sets(st.sampled_from(["a", "a-2", "a-4", "a-5", "a-2-2", "b-3", "c"])))
def test_unique_slugs_equal_the_sequential_rule(spark, bases, taken):
    rows = spark.createDataFrame(list(enumerate(bases)), "o int, base string").repartition(3)
    got = entities.unique_slugs(rows, "base", ["o"], spark.createDataFrame([(t,) for t in taken], "slug string")).orderBy("o").collect()
    assert [r.unique_slug for r in got] == plain_slugs(bases, taken)


def test_unique_slugs_of_a_hot_base_and_nulls(spark):
    bases = ["acme"] * 20_000 + [f"acme-{i}" for i in range(2, 3000, 7)] + ["acme"] * 5 + ["zeta"]
    taken = [f"acme-{i}" for i in range(5, 9000, 3)]
    rows = spark.createDataFrame([*enumerate(bases), (-1, None)], "o int, base string").repartition(6)
    frame = entities.unique_slugs(rows, "base", ["o"], spark.createDataFrame([(t,) for t in taken], "slug string"))
    got = {r.o: r.unique_slug for r in frame.collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(bases))] == plain_slugs(bases, taken)
    assert "Arrow" not in frame._jdf.queryExecution().executedPlan().toString()


def test_addresses_join_people_by_an_index(spark):
    none = spark.range(30_000).select(F.lit("f").alias("slug"), F.col("id").alias("n"))
    w = F.translate(F.col("n").cast("string"), "0123456789", "abcdefghij")
    blank = [F.lit(None).cast("string").alias(c) for c in ("title", "phone", "profile_url")] + [F.array().cast("array<string>").alias(c) for c in ("source_pages", "sources")] + [F.lit(False).alias(c) for c in ("schema_person", "from_attorney_bio", "from_careers_privacy", "from_linkedin")]
    people = none.select("slug", F.concat(F.lit("Dana Vale"), w).alias("name"), F.lit(None).cast("string").alias("email"), *blank, F.col("n").alias("ord"))
    mails = none.select("slug", F.lit(None).cast("string").alias("name"), F.concat(F.lit("d.vale"), w, F.lit("@f.example")).alias("email"), *blank, (F.col("n") + 100_000).alias("ord"))
    got = entities.merged_contacts(people.unionByName(mails)).agg(F.count("*").alias("n"), F.count("name").alias("named"), F.count("email").alias("mailed")).first()
    assert tuple(got) == (30_000, 30_000, 30_000)


def test_containment_of_short_words_and_inside_words(spark):
    names = [("s1", "LEE KIM DDS"), ("s2", "ABC"), ("s3", "OVALE TRIALS"), ("s4", "OAK")]
    b = spark.createDataFrame([(s, n, None) for s, n in names], "slug string, name string, phone string")
    wanted = ["LEE KIM", "XX ABCD", "VALE TRIAL", "PIN OAK CO", "NOBODY ELSE"]
    c = spark.createDataFrame([(i, n, None) for i, n in enumerate(wanted)], "ord int, firm string, phone string")
    assert [r.slug for r in entities.matched(c, b).orderBy("ord").collect()] == ["s1", "s2", "s3", "s4", None]
    w = c.select("ord", F.col("firm").alias("key"))
    plan = entities.contained_match(w.withColumnRenamed("ord", "i"), b.selectExpr("slug as ord", "name as name_key"), "key", "name_key", ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contact_merge_and_rank(spark):
    m = entities.merged_contacts(fixtures.contacts(spark))
    got = {(r.slug, r.name or r.email): r for r in m.collect()}
    dana = got["f", "dana vale"] if ("f", "dana vale") in got else got["f", "Dana Vale"]
    assert (dana.email, dana.phone, dana.title, dana.profile_url) == ("dana.vale@f.example", "+1-512-555-0150", "Founding Partner", "https://f.example/team/dana")
    assert dana.source_pages == ["p1", "p2", "p3"] and dana.schema_person and dana.kind == "person" and dana.poc_score == 5 + 4 + 3 + 2 + 1
    assert got["f", "info@f.example"].source_pages == ["p1", "p4"] and got["f", "info@f.example"].kind == "inbox"
    assert got["f", "Jordan Kim"].poc_score == 5 + 3 - 2 and got["f", "Lee Park"].source == "linkedin" and got["f", "Lee Park"].poc_score == 6
    best = ranking.best_contact(m)
    assert {r.slug: r.name for r in best.collect()} == {"f": dana.name, "g": None}
    assert [r.slug for r in ranking.shortlist(best).collect()] == ["f"]
    assert {r.slug: (r.email, r.pages) for r in ranking.inbox_fallback(m).collect()} == {"f": ("info@f.example", ["p1", "p4"]), "g": ("office@g.example", ["q"])}


def test_preparation(spark):
    limits = spark.createDataFrame([("Law", True, 1, 0.5, None)], "category string, specialty_required boolean, min_notes int, min_site_fill double, specialty_mode string")
    results = spark.createDataFrame([("vale", "https://www.linkedin.com/company/vale/", [("Kim Stone", "Owner", None, "https://www.linkedin.com/in/kim/"), ("LinkedIn Member", None, None, None)])], "slug string, linkedin_company string, contacts array<struct<name:string,title:string,email:string,profile_url:string>>")
    p = prep.prepare(fixtures.businesses(spark), fixtures.pages(spark), limits, "Law", results=results)
    assert [(r.category, r.verdict) for r in p.coverage.where("category = 'Law'").collect()] == [("Law", "COVERED")]
    assert [r.slug for r in p.queue.collect()] == ["acme-law", "vale"]
    people = {r.name: r for r in p.contacts.where("slug = 'vale' and kind = 'person'").collect()}
    assert set(people) == {"Dana Vale", "Lee Park", "Kim Stone"}
    assert people["Lee Park"].email in ("lee.park@vale.example", "lpark@vale.example") and people["Lee Park"].phone == "+1-512-555-0151"
    assert [(r.slug, r.name) for r in p.shortlist.collect()] == [("vale", "Dana Vale")]
    prof = {r.slug: r for r in p.profiles.collect()}
    assert (prof["vale"].pages_ok, prof["acme-law"].pages_fetched, prof["vale"].linkedin_status) == (3, 2, "linked")
    assert [e.email for e in prof["acme-law"].emails] == ["intake@acme.example"]
    assert [r.link for r in C.bio_links(fixtures.pages(spark).selectExpr("'vale' as slug", "'vale.example' as site", "url", "html", "ord")).collect()] == ["https://vale.example/attorneys/lee-park"]
    assert prep.resolve_alias("PI") == ("Law", "personal-injury") and prep.specialty("Law", None) == "pi" and prep.specialty("Lawn", None) is None


def test_coverage_with_practice(spark):
    s = metrics.scorecard(fixtures.businesses(spark), "pi").where("category = 'Law'").first()
    assert (s.notes, s.with_phone, s.with_website, s.practice_notes, s.practice_with_phone, s.practice_site_fill) == (2, 1, 2, 2, 1, 1.0)
    assert metrics.scorecard(fixtures.businesses(spark)).where("category = 'Lawn'").first().with_website == 0


def test_identity(spark):
    firms = spark.createDataFrame([("vale", "Vale & Co", "https://www.vale.example", "Vale Company LLC", ["VALE"]), ("none", "Nobody", None, None, None)], "slug string, firm string, website string, legal_name string, company_aliases array<string>")
    t = {r.slug: r for r in identity.targets(firms).collect()}
    assert t["vale"].names == ["vale", "vale and co", "vale company llc"] and t["vale"].official_host == "vale.example" and t["none"].official_host == ""
    import hashlib
    import json

    assert t["vale"].fingerprint == hashlib.sha256(json.dumps({"slug": "vale", "official_host": "vale.example", "names": t["vale"].names}, sort_keys=True).encode()).hexdigest()
    c = "https://www.linkedin.com/company/vale/"
    base = {"official_host": "vale.example", "names": ["vale"], "company_url": c, "requested_url": c, "company_id": None, "canonical_conflict": False, "hosts": ["vale.example"], "display_name": "Vale", "observed_keys": ["vale"], "proof_source_host": None, "proof_target": None, "source": "linkedin"}
    cases = [({}, "profile_domain_and_name"), ({"official_host": ""}, "missing_official_domain"), ({"canonical_conflict": True}, "company_redirect_conflict"), ({"company_url": c + "x"}, "company_redirect_conflict"), ({"hosts": ["other.example"]}, "official_domain_conflict"), ({"display_name": ""}, "missing_company_profile_name"),
             ({"hosts": [], "proof_source_host": "vale.example", "proof_target": c}, "official_site_identity_link"), ({"observed_keys": ["x"]}, "name_or_legal_entity_conflict"), ({"hosts": []}, "name_only_not_identity"), ({"hosts": [], "observed_keys": []}, "no_domain_evidence")]
    schema = "official_host string, names array<string>, company_url string, requested_url string, company_id string, canonical_conflict boolean, hosts array<string>, display_name string, observed_keys array<string>, proof_source_host string, proof_target string, source string, want string"
    df = spark.createDataFrame([tuple((base | change).values()) + (want,) for change, want in cases], schema)
    for r in identity.evaluated(df).collect():
        assert r.reason == r.want, r
    rec = spark.createDataFrame([("a", "linkedin", "u1", "verified", "r", "c1"), ("a", "linkedin", "u2", "conflict", "r", "c2"), ("b", "linkedin", "u1", "verified", "r", "c1"), ("b", "linkedin", "u2", "verified", "r", "c2"), ("c", "linkedin", "u", "blocked", "r", None)], "slug string, source string, requested_url string, status string, reason string, company_url string")
    assert {r.slug: r.status for r in identity.resolved(rec).collect()} == {"a": "verified", "b": "ambiguous", "c": "blocked"}
    rows = spark.createDataFrame([("vale", "linkedin", identity.POLICY, "verified", t["vale"].fingerprint, c, c, "official_link", "vale.example", c, None), ("vale", "linkedin", identity.POLICY, "verified", "old", c, c, "official_link", "vale.example", c, None), ("vale", "linkedin", identity.POLICY, "verified", t["vale"].fingerprint, c, c, "profile_website", None, None, "evil.example")], "slug string, source string, policy string, status string, fingerprint string, company_url string, stated_company string, evidence_kind string, evidence_source_host string, evidence_target string, evidence_target_host string")
    good, bad = identity.guarded(rows, identity.targets(firms))
    assert good.count() == 1 and sorted(r.quarantine_reason for r in bad.collect()) == ["missing_or_misbound_identity_evidence", "target_changed"]


def test_hiring(spark):
    schema = "slug string, board string, status string, is_hiring boolean, jobs array<string>, checked_at string, stop_reason string"
    before = spark.createDataFrame([("s", "linkedin", "hiring", True, ["j1"], "t0", "exhausted"), ("s", "indeed", "no_public_jobs_found", None, [], "t0", "exhausted")], schema)
    now = spark.createDataFrame([("s", "linkedin", "unknown", None, [], "t1", "blocked")], schema)
    m = {r.board: r for r in hiring.merged_boards(before, now).collect()}
    assert (m["linkedin"].status, m["linkedin"].checked, m["linkedin"].history.status, m["indeed"].checked, m["indeed"].history.status) == ("unknown", True, "hiring", False, "no_public_jobs_found")
    jobs = spark.createDataFrame([("s", "linkedin", "1", None, 0), ("s", "linkedin", "1", None, 1), ("s", "indeed", "1", None, 2)], "slug string, board string, job_id string, url string, ord int")
    assert sorted(r.source_job_key for r in hiring.unique_jobs(jobs).collect()) == ["indeed:1", "linkedin:1"]
    a = hiring.aggregated(hiring.merged_boards(before, now), jobs.where("false")).first()
    assert (a.status, a.is_hiring, a.observed_job_count, a.checked_sources) == ("unknown", None, 0, ["linkedin"])
    pages_ = spark.createDataFrame([("s", "b", 0, "ok", [("1",), ("2",)], "n"), ("s", "b", 1, "ok", [("2",), ("3",)], "n"), ("s", "b", 2, "blocked", [], None), ("t", "b", 0, "ok", [], None), ("u", "b", 0, "blocked", [], None)], "slug string, board string, seq int, status string, jobs array<struct<job_id:string>>, next_url string")
    w = {r.slug: r for r in hiring.listing_walk(pages_).collect()}
    assert ([j.job_id for j in w["s"].jobs], w["s"].stop_reason, w["s"].is_hiring) == (["1", "2", "3"], "blocked", True)
    assert (w["t"].status, w["t"].is_hiring, w["u"].status) == ("no_public_jobs_found", None, "unknown")
    latch = spark.createDataFrame([("p", 0, False), ("p", 1, True), ("p", 2, False)], "p string, seq int, refused boolean")
    assert [r.stopped for r in hiring.refusal_latch(latch, ["p"], "seq", F.col("refused")).orderBy("seq").collect()] == [False, False, True]


COMPANY = "https://www.linkedin.com/company/vale/"
BOARD = f"""<link rel="canonical" href="{COMPANY}"><a href="https://www.linkedin.com/jobs/search?f_C=42">See all jobs</a><section data-test-id="employees-at"><h2>Employees at Vale</h2><ul>
<li><a href="/in/dana"></a><h3>Dana Vale Dana Vale is an Influencer</h3><h4>Owner</h4></li><li><a href="/in/x"></a><h3>LinkedIn Member</h3></li></ul></section>"""
LISTING = f"""<ul><li class="base-search-card"><a href="/jobs/view/clerk-123456">x</a><h3 class="base-search-card__title">Clerk</h3><a href="{COMPANY}">Vale</a><time datetime="2024-01-02">2 days</time></li>
<li class="base-search-card"><a href="/jobs/view/123457">x</a><h3 class="base-search-card__title">Other</h3><a href="https://www.linkedin.com/company/other/">Vale</a></li>
<li class="base-search-card"><a href="/jobs/view/123458">x</a><h3 class="base-search-card__title">Gone</h3><a href="{COMPANY}">Vale</a>No longer accepting applications</li></ul>"""
DETAIL = f"""<link rel="canonical" href="https://www.linkedin.com/jobs/view/123456/"><div class="top-card-layout"><h1 class="top-card-layout__title">Clerk</h1><a class="topcard__org-name-link" href="{COMPANY}">Vale</a></div>
<div class="description"><div class="show-more-less-html__markup"><p>Do <b>work</b></p><ul><li>one</li></ul><script>bad()</script></div></div><li class="description__job-criteria-item"><h3>Seniority level</h3><span class="description__job-criteria-text">Entry</span></li>"""


def test_boards(spark):
    pages_ = {"own": (BOARD, COMPANY), "number": (BOARD, "https://www.linkedin.com/company/42/"), "other": (BOARD, "https://www.linkedin.com/company/other/"), "none": ("<p>x</p>", COMPANY), "hidden": (BOARD.replace("Dana Vale Dana Vale is an Influencer", "LinkedIn Member 1"), COMPANY)}
    df = spark.createDataFrame([(k, h, c) for k, (h, c) in pages_.items()], "k string, html string, company string")
    got = {r.k: r for r in company_pages(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"own": "found", "number": "found", "other": "company_mismatch", "none": "parse_error", "hidden": "names_masked"}
    assert got["number"].company_url == COMPANY and got["other"].contacts == [] and got["hidden"].masked == 2
    r = got["own"]
    assert (r.status, r.company_id, r.masked, [(c.name, c.title, c.profile_url) for c in r.contacts]) == ("found", "42", 1, [("Dana Vale", "Owner", "https://www.linkedin.com/in/dana/")])
    jobs = listed_jobs(spark.createDataFrame([(LISTING, COMPANY, "42")], "html string, company string, company_id string")).first().jobs
    assert [(j.job_id, j.title, j.date_posted) for j in jobs] == [("123456", "Clerk", "2024-01-02")]
    asked = {"own": ("123456", COMPANY, DETAIL), "job": ("999999", COMPANY, DETAIL), "firm": ("123456", "https://www.linkedin.com/company/other/", DETAIL), "wall": ("123456", COMPANY, "<title>Sign in | LinkedIn</title>" + DETAIL), "urn": ("123456", COMPANY, DETAIL.replace('class="top-card-layout"', 'class="top-card-layout" data-entity-urn="urn:li:jobPosting:7"')), "none": ("123456", COMPANY, "<p>x</p>"), "elsewhere": ("123456", COMPANY, DETAIL.replace('class="description"', 'class="about"'))}
    got = {r.k: r for r in job_details(spark.createDataFrame([(k, j, c, h, "42") for k, (j, c, h) in asked.items()], "k string, job_id string, company string, html string, company_id string")).collect()}
    assert {k: r.detail_status for k, r in got.items()} == {"own": "ok", "job": "job_mismatch", "firm": "company_mismatch", "wall": "blocked", "urn": "job_mismatch", "none": "parse_error", "elsewhere": "partial"}
    d = got["own"]
    assert (d.description, d.description_source, d.seniority_level, d.title, d.listing_status) == ("Do work\n\n- one", "html", "Entry", "Clerk", "observed") and "bad" not in d.description_html and got["job"].title is None
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "url": "https://www.linkedin.com/jobs/view/123456", "title": "T", "description": "<p>From <b>it</b></p>", "datePosted": "2024-01-02", "hiringOrganization": {"sameAs": "' + COMPANY + '"}}</script>'
    r = job_details(spark.createDataFrame([("123456", COMPANY, ld, "42")], "job_id string, company string, html string, company_id string")).first()
    assert (r.detail_status, r.description, r.description_source, r.title, r.date_posted) == ("ok", "From it", "json_ld", "T", "2024-01-02")
    page = '<ul><li data-jk="0123456789abcdef"><h2><a href="/viewjob?jk=0123456789abcdef">Cook</a></h2><span data-testid="company-name">Vale</span></li><li><a href="/viewjob?jk=1123456789abcdef">Spy</a><span data-testid="company-name">Other</span></li></ul><a rel="next" href="/jobs?start=10">Next</a>'
    more = '<script type="application/ld+json">{"@type": "JobPosting", "url": "/viewjob?jk=2123456789abcdef", "title": "Baker", "hiringOrganization": {"name": "vale"}}</script>'
    cases = {"name": (page + more, ""), "own": ('<link rel="canonical" href="https://www.indeed.com/cmp/vale"><ul><li><a href="/viewjob?jk=3123456789abcdef">Server</a></li></ul>', "https://www.indeed.com/cmp/vale"), "other": ('<link rel="canonical" href="https://www.indeed.com/cmp/other">' + page, "https://www.indeed.com/cmp/vale"), "wall": ("<title>Just a moment...</title>", "")}
    got = {r.k: r for r in second_listed_jobs(spark.createDataFrame([(k, h, "https://www.indeed.com/jobs?q=x", "VALE", c) for k, (h, c) in cases.items()], "k string, html string, url string, firm string, company string")).collect()}
    assert {k: (r.status, [(j.job_id, j.title) for j in r.jobs], r.next_url) for k, r in got.items()} == {"name": ("ok", [("0123456789abcdef", "Cook"), ("2123456789abcdef", "Baker")], "https://www.indeed.com/jobs?start=10"), "own": ("ok", [("3123456789abcdef", "Server")], ""), "other": ("company_mismatch", [], ""), "wall": ("blocked", [], "")}


def test_dom_rows(spark):
    spark.udtf.register("dom_nodes", DomNodes)
    spark.createDataFrame([("<aside><p>no</p></aside><p id=x>yes <b>bold</b></p>",)], "h string").createOrReplaceTempView("dom_pages")
    rows = spark.sql("select n.* from dom_pages, lateral dom_nodes(h) n where tag = 'p' order by node_id").collect()
    assert [(r.text, r.excluded, r.depth) for r in rows] == [("no", True, 2), ("yes", False, 1)]
    assert one(spark, {"h": '<p>a</p><a href="javascript:x">b</a><script>c</script>'}, safe_description("h").alias("d")).d.html == "<p>a</p><a>b</a>"


def test_crawl(spark):
    robots = spark.createDataFrame([("a.example", "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /\n\nUser-agent: *\nAllow: /x\nSitemap: https://a.example/s.xml")], "site string, body string")
    got = {r.bot: r.signal for r in pages.robot_rules(robots, list(H.AI_BOTS)).collect()}
    assert got == {"GPTBot": "disallow-/ with allows", "ClaudeBot": "disallow-/ with allows", "Google-Extended": "allow-rules (1)", "PerplexityBot": "allow-rules (1)"}
    alone = {r.bot: r.signal for r in pages.robot_rules(robots, list(H.AI_BOTS), grouped=False).collect()}
    assert alone["GPTBot"] == "allow-rules (1)" and alone["ClaudeBot"] == "disallow-/ with allows"
    maps = spark.createDataFrame([("https://a.example/s.xml", "<sitemapindex><sitemap><loc>https://a.example/t.xml</loc></sitemap></sitemapindex>"), ("https://a.example/t.xml", "<urlset><url><loc>https://a.example/p</loc></url><url><loc>https://b.example/q</loc></url></urlset>")], "url string, body string")
    start = spark.createDataFrame([("a.example", "https://a.example/sitemap.xml")], "site string, url string")
    assert [r.url for r in pages.frontier(start, robots, maps).collect()] == ["https://a.example/p"]
    r = pages.records(fixtures.pages(spark).where("html is not null").withColumn("page_id", F.col("ord")), "page_id").where("page_id = 0").first()
    assert r.outbound_same_site_sample == ["https://vale.example/contact", "https://vale.example/attorneys/lee-park"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nname: "Vale"\nphone: (512) 555-0100\nwebsite:\ncategory: "[[Law]]"\nlocally_owned: true\ncompany_aliases: ["V", "W"]\n---\n# Vale\nhttps://www.linkedin.com/company/vale\n## Contacts\n- Dana Vale — Owner — dana@vale.example — 512-555-0101\n- x\n## Call log\n')
    (tmp_path / "b.md").write_text("no front matter")
    b = {r.slug: r for r in documents.businesses(documents.notes(spark, str(tmp_path))).collect()}
    assert (b["a"].name, b["a"].phone, b["a"].website, b["a"].category, b["a"].locally_owned, b["a"].company_aliases, b["a"].linkedin_company) == ("Vale", "+1-512-555-0100", None, "Law", True, ["V", "W"], "https://www.linkedin.com/company/vale")
    assert b["b"].name == "b" and b["b"].error is None
    c = documents.note_contacts(documents.businesses(documents.notes(spark, str(tmp_path)))).orderBy("ord").collect()
    assert (c[0].name, c[0].title, c[0].email, c[0].phone) == ("Dana Vale", "Owner", "dana@vale.example", "+1-512-555-0101") and c[1].name == "x"
    (tmp_path / "r-1.jsonl").write_text('{"slug":"s","status":"old"}\nbroken\n{"slug":"s","status":"mid"}\n')
    (tmp_path / "r-2.jsonl").write_text('{"slug":"t","status":"x"}\n')
    rows = documents.results(spark, str(tmp_path / "*.jsonl"))
    assert rows.where("_corrupt is not null").count() == 1
    assert {r.slug: r.status for r in documents.latest_results(rows).collect()} == {"s": "mid", "t": "x"}
    har = spark.createDataFrame([("c", '{"log":{"entries":[{"request":{"method":"GET","url":"https://h.example/i/graphql/Q/Op?queryId=7&x=1","headers":[{"name":"Cookie","value":"s3cr3t"},{"name":"X-Foo","value":"v"},{"name":"Other","value":"v"}]},"response":{"status":200,"content":{"text":"abc"}}}]}}')], "capture string, body string")
    e = documents.har_entries(har)
    r = e.first()
    assert (r.path, r.query, r.header_names, r.bytes, r.template) == ("/i/graphql/Q/Op", {"queryId": "7"}, ["cookie", "x-foo"], 3, "https://h.example/i/graphql/Q/Op")
    assert filters.leaks(e, ["s3cr3t"]).count() == 0 and metrics.request_counts(e).first().n == 1
    p = spark.createDataFrame([("h", '[{"id":"1","text":"a b c d e","favorite_count":3},{"id":"1","text":"z"},{"id":"2","text":" "}]'), ("i", '{"handle":"x","posts":[{"id":"9","text":"q"}]}')], "archive_id string, body string")
    assert sorted((r.archive_id, r.id, r.favorite_count) for r in documents.posts(p).collect()) == [("h", "1", 3), ("h", "2", None), ("i", "9", None)]
    assert documents.digest_posts(p).count() == 2


def test_sinks(spark, tmp_path):
    q = str(tmp_path / "queue")
    rows = spark.createDataFrame([("a",), ("b",)], "slug string")
    assert sinks.append_queue(rows, q, ["slug"]).count() == 2
    more = spark.createDataFrame([("b",), ("c",)], "slug string")
    sinks.append_queue(more, q, ["slug"])
    assert sorted(r.slug for r in spark.read.json(q).collect()) == ["a", "b", "c"]
    note = sinks.rendered_notes(fixtures.businesses(spark).where("slug = 'vale'")).first().text
    back = documents.businesses(spark.createDataFrame([("vale", "p", note)], "slug string, path string, text string")).first()
    assert (back.name, back.category, back.website) == ("Vale Trial Group", "Law", "https://vale.example")
    text = one(spark, {"t": note}, sinks.replaced_section(F.col("t"), "Contacts", F.lit("- x")).alias("t")).t
    assert "## Contacts\n- x\n" in text and text.count("## Contacts") == 1 and "## Call log" in text
    assert 'website: "https://n.example"' in one(spark, {"t": note}, sinks.set_front(F.col("t"), "website", F.lit("https://n.example")).alias("t")).t
    upd = spark.createDataFrame([("vale", "", "https://www.yelp.com/x"), ("acme-law", "512", None)], "slug string, phone string, website string")
    got = {r.slug: r for r in merge.update_fields(fixtures.businesses(spark), upd).collect()}
    assert got["vale"].website == "https://vale.example" and got["acme-law"].phone == "512"


def test_validation_and_retries(spark):
    rows = spark.createDataFrame([("a", None, [("n",)]), (None, None, [("",)])], "slug string, path string, contacts array<struct<name:string>>")
    assert [r.errors for r in filters.validated(rows).orderBy(F.col("slug").desc()).collect()] == [[], ["slug or path is required", "contact without name"]]
    prior = spark.createDataFrame([("https://a/x", "timeout", "", 0), ("https://a/y", "ok", "old", 1)], "url string, status string, title string, ord int")
    again = spark.createDataFrame([("https://A/x/", "ok", "new", 0), ("https://a/y", "ok", "newer", 1)], "url string, status string, title string, ord int")
    assert [(r.title, r.status) for r in merge.retried_pages(prior, again).orderBy("ord").collect()] == [("new", "ok"), ("old", "ok")]
    assert each(spark, ["200", "404", "0"], lambda c: filters.http_outcome(c.cast("int"))) == ["ok", "http_error", "error"]
    df = spark.createDataFrame([("Vale trial lawyers of Austin", ["vale", "trial"], "Dana Vale")], "t string, k array<string>, p string")
    assert df.select(filters.mentions_firm("t", "k"), filters.names_person("t", "p")).first() == (True, False)
