"""Small invented inputs in the shapes of landed data. No real person, firm or number."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def payloads(spark: SparkSession) -> DataFrame:
    permits = [
        {"outlet_name": "Bluebonnet Roofing Co", "outlet_city": "AUSTIN", "outlet_address": "1 Oak St", "outlet_zip_code": "78701", "outlet_state": "TX", "outlet_naics_code": "238160"},
        {"outlet_name": "bluebonnet roofing co", "outlet_city": "Austin"},
        {"outlet_name": "", "taxpayer_name": "Lone Pine Roofing Supply", "taxpayer_city": "waco"},
        {"outlet_name": "State Farm Agency", "outlet_city": "Dallas"},
        {"license_type": "Broker", "full_name": "Shaped Otherwise"},
    ]
    brokers = [
        {"license_type": "Broker Company", "status": "Active", "full_name": "Pecan Realty LLC", "county": "travis", "license_number": "77"},
        {"license_type": "Sales Agent", "status": "Active", "full_name": "Agent Person"},
        {"license_type": "Broker Individual", "status": "", "full_name": "Solo Person"},
        {"license_type": "Broker", "status": "Expired", "full_name": "Old Broker"},
    ]
    contractors = [
        {"license_type": "A/C Contractor", "business_name": "Cool Air Heating", "business_telephone": "(512) 555-0100", "business_city_state_zip": "ROUND ROCK, TX 78664", "business_address_line1": "5 Elm", "license_number": "T1"},
        {"license_type": "A/C Technician", "business_name": "Not A Firm"},
        {"license_type": "A/C Contractor", "business_name": "Cool Air Heating", "owner_telephone": "15125550100"},
    ]
    elements = {
        "elements": [
            {"type": "node", "id": 5, "tags": {"name": "Cedar Dental", "contact:phone": "+1 512-555-0111", "website": "https://cedardental.example/?x=1", "addr:city": "o'neil-park", "addr:housenumber": "9", "addr:street": "Main"}},
            {"type": "way", "id": 6, "tags": {"operator": "Mesa Clinic", "website": "https://www.yelp.com/biz/mesa"}},
            {"type": "node", "id": 7, "tags": {"amenity": "bench"}},
        ]
    }
    providers = {
        "results": [
            {"number": "1", "basic": {"organization_name": "HILL HEALTH PLLC"}, "other_names": [{"organization_name": "Hill Family Clinic", "type": "Doing Business As", "code": "3"}], "taxonomies": [{"desc": "Family Medicine"}], "addresses": [{"address_purpose": "MAILING", "city": "X"}, {"address_purpose": "LOCATION", "telephone_number": "512-555-0122", "city": "AUSTIN", "address_1": "7 Hill", "postal_code": "787011234", "state": "TX"}]},
            {"number": "2", "basic": {"organization_name": "Corner Pharmacy"}, "taxonomies": [{"desc": "Pharmacy"}], "addresses": []},
        ]
    }
    people = [{"@type": "Person", "name": "Ann O&#39;Hara", "url": "https://dir.example/ann", "workLocation": {"@type": "LegalService", "name": "O&#39;Hara &amp; Vale", "telephone": "512.555.0133", "address": {"streetAddress": ["3 Law Way", "Ste 2"], "addressLocality": "Austin", "addressRegion": "TX", "postalCode": "78702"}}}]
    html = f'<html><script type="application/ld+json">{{"@type":"WebSite"}}</script><script type="application/ld+json">{json.dumps(people)}</script></html>'
    firms = '<h2>Vale Trial Group</h2><a href="tel:(512) 555-0144">call</a><a class="website-button-link" href="https://valetrial.example/home?utm=1">Visit</a>'
    rows = [
        ("comptroller_roofing", "soda", None, "https://data.example/permits", json.dumps(permits)), ("trec_brokers", "soda", ["trec"], "https://data.example/brokers", json.dumps(brokers)), ("tdlr_all", "soda", ["tdlr"], "https://data.example/licences", json.dumps(contractors)),
        ("osm_dentist", "overpass", None, "https://maps.example", json.dumps(elements)), ("nppes_medical", "nppes", None, "https://npi.example", json.dumps(providers)), ("justia_pi", "html", None, "https://dir.example/austin/texas", html), ("findlaw_pi", "html", None, "https://find.example/round-rock/texas", firms), ("tbpe_roster", "zip_csv", None, "https://pe.example", "x"), ("broken", "soda", None, "https://bad.example", "not json"),
    ]
    return spark.createDataFrame(rows, "recipe string, kind string, parse array<string>, source_url string, body string")


def businesses(spark: SparkSession) -> DataFrame:
    rows = [
        ("acme-law", "Acme Law Firm", "Austin", "Law", "personal-injury", "+1-512-555-0133", "https://acme.example", None, None, "prospect", "Justia"), ("birch", "Birch Roofing", "Waco", "Roofing", None, None, None, None, None, "prospect", "Comptroller"),
        ("bluebonnet", "Bluebonnet Roofing", "Austin", "Roofing", None, None, None, None, None, "prospect", "Comptroller"), ("vale", "Vale Trial Group", "Austin", "Law", "personal-injury", None, "https://vale.example", None, "https://www.linkedin.com/company/vale/", "prospect", "FindLaw"), ("lawn", "Green Lawn", "Austin", "Lawn", None, None, "n/a", None, None, "prospect", "Comptroller"),
    ]
    return spark.createDataFrame(rows, "slug string, name string, city string, category string, practice string, phone string, website string, address string, linkedin_company string, status string, source string").selectExpr("*", "cast(null as string) as email")


PAGE_ONE = """<html><head><title>Vale Trial Group | Austin Trial Team</title><meta name="description" content="Trial &amp; injury help">
<script type="application/ld+json">{"@type":"LegalService","employee":[{"@type":"Person","name":"Dana Vale","jobTitle":"Founding Partner","email":"mailto:dana.vale@vale.example","telephone":"(512) 555-0150"}],"review":{"@type":"Review","author":{"@type":"Person","name":"Happy Client"}}}</script></head>
<body><h1>Austin Trial Team</h1><h2>Results</h2><ul><li>Truck &amp; car</li><li>Truck &amp; car</li></ul><img alt="Office &amp; sign" src="x.png"><button>Call now</button><a href="/contact">Contact us</a><a href="/attorneys/lee-park#top">x</a><a href="/attorneys/lee-park">Lee Park</a>
<p>Write to <a href="mailto:info@vale.example?subject=x">info@vale.example</a> or lee.park@vale.example, Lee Park, Partner, phone: 512-555-0151. logo@2x.png joe@gmail.com</p><a href="tel:+15125550152">call</a></body></html>"""
PAGE_TWO = """<html><head><title>Lee Park | Vale</title></head><body><h1>Lee Park</h1><p>Lee Park is a Partner. lpark@vale.example <a href="tel:512-555-0151">512-555-0151</a></p></body></html>"""


def pages(spark: SparkSession) -> DataFrame:
    rows = [("https://vale.example/", PAGE_ONE, "ok", 0), ("https://vale.example/attorneys/lee-park", PAGE_TWO, "ok", 1), ("https://vale.example/careers", "<title>Careers</title>jobs hr@vale.example", "ok", 2), ("https://acme.example/", "<title>Acme</title><h1>Acme</h1>intake@acme.example", "ok", 3), ("https://acme.example/contact", None, "timeout", 4)]
    return spark.createDataFrame(rows, "url string, html string, status string, ord long")


def contacts(spark: SparkSession) -> DataFrame:
    none = None
    rows = [
        ("f", "Dana Vale", none, "info@f.example", none, "https://f.example/team/dana", ["p1"], ["website"], False, True, False, False, 0), ("f", "dana vale", "Founding Partner", "dana.vale@f.example", none, none, ["p2"], ["website"], True, False, False, False, 1), ("f", none, none, "dvale@f.example", "+1-512-555-0150", none, ["p3"], ["website"], False, False, False, False, 2),
        ("f", "Contact Us", none, "info@f.example", none, none, ["p1", "p4"], ["website"], False, False, False, False, 3), ("f", none, none, "jordan.kim@f.example", none, none, ["p5"], ["website"], False, False, True, False, 4), ("f", "Lee Park", "Associate", none, none, "https://www.linkedin.com/in/lee/", ["b"], ["linkedin"], False, False, False, True, 5),
        ("g", none, none, "office@g.example", none, none, ["q"], ["website"], False, False, False, False, 6),
    ]
    return spark.createDataFrame(rows, "slug string, name string, title string, email string, phone string, profile_url string, source_pages array<string>, sources array<string>, schema_person boolean, from_attorney_bio boolean, from_careers_privacy boolean, from_linkedin boolean, ord long")


def post(id_: str, text: str, likes: int, **more) -> dict:
    return {"rest_id": id_, "legacy": {"full_text": text, "created_at": "Mon Jan 01 10:00:00 +0000 2024", "favorite_count": likes}, **more}


def timeline(posts: list[dict], cursor: str | None) -> str:
    entries = [{"content": {"itemContent": {"tweet_results": {"result": p}}}} for p in posts]
    entries += [{"content": {"cursorType": "ShowMore", "value": "more"}}] + ([{"content": {"cursorType": "Bottom", "value": cursor}}] if cursor else [])
    return json.dumps({"data": {"timeline": {"instructions": [{"entries": entries}]}}})


def payload_pages(spark: SparkSession) -> DataFrame:
    long = {"note_tweet": {"note_tweet_results": {"result": {"text": "the long form of two"}}}, "views": {"count": "12"}}
    rows = [
        ("a", 0, 200, {"X-Rate-Limit-Remaining": "5"}, timeline([post("1", "one two three four five", 3), post("2", "two", 1, **long)], "c1")), ("a", 1, 429, {}, "{}"), ("a", 2, 200, {"x-rate-limit-remaining": "0", "x-rate-limit-reset": "1700000000"}, timeline([post("1", "", 9) | {"note_tweet": {"note_tweet_results": {"result": {"text": "one two three four five"}}}}, post("3", "three", 0)], "c2")), ("a", 3, 200, {}, timeline([], "c3")), ("a", 4, 200, {}, timeline([post("9", "after the end", 0)], None)),
        ("b", 0, 200, {}, timeline([post("1", "one", 0)], "x")), ("b", 1, 429, {}, ""), ("b", 2, 429, {}, ""), ("c", 0, 200, {}, "not json"), ("d", 0, 200, {"x-rate-limit-remaining": "0"}, timeline([post("5", "five", 0)], "y")), ("e", 0, 200, {}, timeline([post("6", "six", 0)], "z")), ("e", 1, 500, {}, ""),
    ]
    return spark.createDataFrame(rows, "archive_id string, seq long, status int, headers map<string,string>, body string")
