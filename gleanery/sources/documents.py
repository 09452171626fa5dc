"""Readers of note documents, result files, post archives, captures and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import _c, filled, phone, website_value
from gleanery.functions.urls import query_value, template
from gleanery.operators.dedup import first_wins, latest_by
from gleanery.sources import schemas

SENSITIVE = ("cookie", "authorization", "csrf-token", "x-csrf-token", "set-cookie", "x-li-identity")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """path, slug and text of the note documents in a folder."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("slug"), F.col("value").alias("text"))
    return raw


def front(text: Column | str) -> Column:
    """The front matter of a note as a map of text; its first line of each key counts last, as in a dictionary."""
    t = _c(text)
    block = F.when(t.startswith("---"), F.try_element_at(F.split(t, "---", 3), F.lit(2)))
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), '^"+|"+$', "").alias("v"))
    entries = F.transform(lines, entry)
    # Later lines win: keys first seen from the end.
    last = F.filter(F.reverse(entries), lambda e: e["k"] != "")
    kept = F.aggregate(last, F.expr("cast(array() as array<struct<k:string,v:string>>)"), lambda acc, e: F.when(F.exists(acc, lambda a: a["k"] == e["k"]), acc).otherwise(F.concat(acc, F.array(e))))
    return F.coalesce(F.map_from_entries(kept), F.create_map().cast("map<string,string>"))


def body(text: Column | str) -> Column:
    t = _c(text)
    parts = F.split(t, "---", 3)
    return F.when(t.startswith("---") & (F.size(parts) == 3), parts[2]).otherwise(t)


def front_value(text: Column | str, key: str) -> Column:
    """One value of the front matter. An empty one is null; the next line is never taken for it."""
    return filled(F.regexp_extract(_c(text), rf'(?m)^{key}:[ \t]*"?([^\n"]*)"?[ \t]*$', 1))


def unlinked(x: Column) -> Column:
    """[[Law]] as Law."""
    return F.regexp_replace(x, r"^\[\[|\]\]$", "")


def businesses(raw: DataFrame) -> DataFrame:
    """Notes as typed rows. Aliases are a JSON list; what isn't one is an error of the row, not of the scan."""
    v = lambda k: filled(F.try_element_at("front", F.lit(k)))
    rows = raw.withColumns({"front": front("text"), "body": body("text")})
    aliases = v("company_aliases")
    link = lambda pattern: F.when(F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))) == 1, F.regexp_extract("text", pattern, 1))
    return rows.select(
        "slug", "path", F.coalesce(v("name"), "slug").alias("name"), unlinked(v("city")).alias("city"), unlinked(v("category")).alias("category"), v("practice").alias("practice"), F.coalesce(phone(v("phone")), v("phone")).alias("phone"),
        website_value(v("website")).alias("website"), *[v(c).alias(c) for c in ("address", "owner", "ein", "license", "status", "research_status", "profile_score", "last_called", "notes", "email", "legal_name")],
        (F.lower(v("locally_owned")) == "true").alias("locally_owned"), unlinked(v("source")).alias("source"),
        F.coalesce(v("linkedin_company"), link(r"(https://www\.linkedin\.com/company/[A-Za-z0-9%_-]+)")).alias("linkedin_company"), F.coalesce(v("indeed_company"), link(r"(https://www\.indeed\.com/cmp/[A-Za-z0-9%_-]+)")).alias("indeed_company"),
        F.from_json(F.regexp_replace(aliases, r'\\"', '"'), "array<string>").alias("company_aliases"), F.when(aliases.isNotNull() & F.from_json(F.regexp_replace(aliases, r'\\"', '"'), "array<string>").isNull(), "company_aliases").alias("error"), "front", "body",
    )


def section(text: Column | str, heading: str) -> Column:
    """The text of a section of a note."""
    return filled(F.regexp_extract(_c(text), rf"(?ms)^##\s+{heading}\s*$(.*?)(?=^##\s|\z)", 1))


def note_contacts(rows: DataFrame) -> DataFrame:
    """Contacts in the bullets of notes: parts between dashes told apart by what they look like."""
    bullets = F.filter(F.transform(F.split(section("body", "Contacts"), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[-*]\s+\S"))
    b = rows.select("slug", F.posexplode(bullets).alias("ord", "b")).withColumn("parts", F.transform(F.split(F.regexp_replace("b", r"^[-*]\s+", ""), r"\s+—\s+"), lambda x: F.trim(x)))
    first = lambda f: F.try_element_at(F.filter("parts", f), F.lit(1))
    url, mail, call = first(lambda x: x.startswith("http")), first(lambda x: x.contains("@") & ~x.contains(" ")), first(lambda x: phone(x).isNotNull())
    rest = F.filter(F.slice("parts", 2, 9), lambda x: ~x.startswith("http") & ~(x.contains("@") & ~x.contains(" ")) & phone(x).isNull())
    return b.select("slug", "ord", F.col("parts")[0].alias("name"), F.try_element_at(rest, F.lit(1)).alias("title"), F.lower(mail).alias("email"), phone(call).alias("phone"), url.alias("profile_url"))


def contact_bullet(name: Column, title: Column, email: Column, url: Column) -> Column:
    return F.concat(F.lit("- "), F.concat_ws(" — ", *[filled(x) for x in (name, title, email, url)]))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSONL result files with file and line; bad lines have what they hold in _corrupt and go on."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "raw")).where("trim(raw) <> ''")
    return lines.select("file", "line", F.from_json("raw", schemas.RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("file", "line", "r.*")


def latest_results(rows: DataFrame) -> DataFrame:
    """The last row of each slug, by file name and line."""
    good = rows.where("_corrupt is null and slug is not null").drop("_corrupt")
    return latest_by(good, ["slug"], ["file", "line"])


def latest_runs(runs: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """Of the crawl runs (slug, file, ...) the one a profile points to, else the one with the last name."""
    if pointers is None:
        return latest_by(runs, ["slug"], ["file"])
    p = pointers.select(F.col("slug").alias("_s"), F.col("file").alias("_f"))
    j = runs.join(p, (F.col("slug") == F.col("_s")) & (F.col("file") == F.col("_f")), "left").withColumn("_pointed", F.col("_s").isNotNull()).drop("_s", "_f")
    return latest_by(j, ["slug"], ["_pointed", "file"]).drop("_pointed")


def profiles(spark: SparkSession, path: str, schema: str, category: str | None = None) -> DataFrame:
    """Firm profiles of a folder, without index files and broken ones."""
    p = spark.read.schema(schema).json(path, mode="DROPMALFORMED", multiLine=True, pathGlobFilter="*.json").where(~F.col("_metadata.file_name").rlike("^(_|index)"))
    return p.where(F.lower("category") == category.lower()) if category and category not in ("all", "*") else p


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the coverage file: one category each."""
    return spark.read.json(path, multiLine=True).select(F.explode("rows").alias("r")).select("r.*")


def posts(archives: DataFrame) -> DataFrame:
    """Posts of archive files (archive_id, body), first of each id, numbers kept. Bodies are a list or {handle, posts}."""
    one = schemas.POSTS.split("posts ")[1]
    listed = F.from_json("body", one)
    inner = F.from_json("body", schemas.POSTS)["posts"]
    rows = archives.select("archive_id", F.posexplode(F.when(F.col("body").rlike(r"^\s*\["), listed).otherwise(inner)).alias("ord", "p")).select("archive_id", "ord", "p.*")
    return first_wins(rows.where(filled("id").isNotNull()), ["archive_id", "id"], ["ord"])


def digest_posts(archives: DataFrame) -> DataFrame:
    """Posts that have a text."""
    return posts(archives).where(filled("text").isNotNull()).select("archive_id", "ord", "id", "text", "created_at")


def har_entries(captures: DataFrame) -> DataFrame:
    """Requests of captured sessions (capture, body): template, method, status, header names, size and kept query keys. Header values are never read."""
    e = captures.select("capture", F.posexplode(F.from_json("body", schemas.HAR)["log"]["entries"]).alias("ord", "e")).where(filled("e.request.url").isNotNull())
    url = F.col("e.request.url")
    names = F.array_sort(F.array_distinct(F.transform("e.request.headers", lambda h: F.lower(h["name"]))))
    kept = F.filter(names, lambda n: n.isin(*SENSITIVE) | n.startswith("x-") | n.isin("accept", "content-type"))
    query = F.map_filter(F.create_map(*[x for k in ("queryId", "variables") for x in (F.lit(k), F.substring(query_value(url, k), 1, 180))]), lambda _, v: v.isNotNull())
    return e.select(
        "capture", "ord", F.col("e.request.method").alias("method"), F.col("e.response.status").alias("status"), F.regexp_extract(url, "://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"),
        query.alias("query"), kept.alias("header_names"), F.coalesce(F.length("e.response.content.text"), F.lit(0)).alias("bytes"), template(url).alias("template"),
    )


def hits(captures: DataFrame) -> DataFrame:
    """Captured responses (capture, ord, url, method, status, operation, body) with the operation from the address where it is missing."""
    from gleanery.functions.urls import operation

    return captures.withColumn("operation", F.coalesce(filled("operation"), operation("url")["operation"])).withColumns({"query_id": operation("url")["query_id"], "template": template("url"), "bytes": F.coalesce(F.length("body"), F.lit(0))})
