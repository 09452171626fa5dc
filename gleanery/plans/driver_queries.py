"""Operators applied to the driver's tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions import text as X
from gleanery.functions import urls as U
from gleanery.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ROLES = ", ".join(f"'{x}'" for x in X.ROLE_INBOXES)
_FREE = ", ".join(f"'{x}'" for x in X.FREE_MAIL)
_SUFFIX = ", ".join(f"'{x}'" for x in U.TWO_PART_SUFFIXES)
_ASSETS = r"\.(png|jpg|jpeg|gif|svg|webp|css|js)$"


def _reg(h: str) -> str:
    """SQL of the registrable domain of a host expression."""
    s = f"regexp_replace(regexp_replace(lower({h}), '\\.+$', ''), '^www\\.', '')"
    parts = f"string_split({s}, '.')"
    return f"""CASE WHEN strpos({s}, '.') = 0 THEN {s}
      WHEN len({parts}) >= 3 AND array_to_string({parts}[-2:], '.') IN ({_SUFFIX}) THEN array_to_string({parts}[-3:], '.')
      ELSE array_to_string({parts}[-2:], '.') END"""


_EMAILS = rf"""
  SELECT doc_id, lower(regexp_replace(m, '[.,;:)>\]]+$', '')) AS email
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', 1)) AS m FROM documents)
  WHERE NOT regexp_matches(lower(m), '{_ASSETS}')"""
_LOCAL = "split_part(email, '@', 1)"
_ROLE = f"({_LOCAL} IN ({_ROLES}) OR split_part(split_part({_LOCAL}, '.', 1), '+', 1) IN ({_ROLES}))"
_KIND = f"""CASE WHEN {_ROLE} THEN 'role'
  WHEN length({_LOCAL}) >= 2 AND regexp_matches({_LOCAL}, '^([a-z]{{1,20}}[._-][a-z]{{1,20}}|[a-z]\\.?[a-z]{{2,20}}|[a-z]{{3,30}})$') THEN 'personal' ELSE 'other' END"""


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.emails_in("text", unescape=False)).alias("email"))


@query(f"""
WITH e AS (SELECT DISTINCT doc_id, email FROM ({_EMAILS}))
SELECT {_reg("split_part(email, '@', 2)")} AS site, {_KIND} AS kind, count(*) AS n_found, count(DISTINCT doc_id) AS n_documents, count(DISTINCT email) AS n_addresses
FROM e WHERE {_reg("split_part(email, '@', 2)")} NOT IN ({_FREE}) GROUP BY 1, 2""")
def email_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site e-mail inventory: addresses by registrable domain and kind, free mail left out."""
    e = _emails(spark, sf_dir).select("doc_id", "email", U.registrable(X.email_domain("email")).alias("site"), X.email_kind("email").alias("kind"))
    return e.where(~F.col("site").isin(X.FREE_MAIL)).groupBy("site", "kind").agg(F.count("*").alias("n_found"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("email").alias("n_addresses"))


@query(f"WITH e AS (SELECT DISTINCT doc_id, email FROM ({_EMAILS})) SELECT doc_id, email FROM e")
def emails_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emails(spark, sf_dir)


@query(f"""
WITH e AS (SELECT DISTINCT email FROM ({_EMAILS}))
SELECT email, {_KIND} AS kind, {_ROLE} AS is_role,
  CASE WHEN {_ROLE} THEN 0 WHEN regexp_matches({_LOCAL}, '^[a-z]+\\.[a-z]+$') THEN 3
    WHEN regexp_matches({_LOCAL}, '^[a-z]{{3,}}$') THEN 2 WHEN {_KIND} = 'personal' THEN 3 ELSE 0 END AS bonus
FROM e""")
def email_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emails(spark, sf_dir).select("email").distinct()
    return e.select("email", X.email_kind("email").alias("kind"), X.is_role_inbox("email").alias("is_role"), X.personal_email_bonus("email").alias("bonus"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


@query(f"""
SELECT page_id, {_HOST} AS host, {_reg(_HOST)} AS site, {_PATH} AS path,
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {_HOST} || {_PATH} AS normalized,
  lower(regexp_replace(url, '/+$', '')) AS crawl_key, {_HOST} ~ '.*({"|".join(x.replace(".", r"[.]") for x in U.DIRECTORY_HOSTS)}).*' AS is_directory
FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.host("url").alias("host"), U.registrable(U.host("url")).alias("site"), U.path("url").alias("path"), U.normalized("url").alias("normalized"), U.crawl_key("url").alias("crawl_key"), U.is_directory("url").alias("is_directory"))


_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _plain(x: str) -> str:
    return "trim(regexp_replace(" + _UNESCAPE.format(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')") + ", '[\\s\\x{a0}]+', ' ', 'g'))"


@query(f"""
SELECT page_id, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  [{_plain("x")} FOR x IN regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)][:5] AS h1s
FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.title("html").alias("title"), H.h1s("html").alias("h1s"))


@query(f"""
WITH i AS (SELECT page_id, {_plain("x")} AS item, pos FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1), 1) AS pos FROM pages)),
f AS (SELECT page_id, item, min(pos) AS pos FROM i WHERE item <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM f)
SELECT page_id, rn AS place, item FROM r WHERE rn <= 40""")
def page_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.list_items("html")).alias("place", "item"))
    return p.select("page_id", (F.col("place") + 1).cast("long").alias("place"), "item")


_SCRIPTLESS = "regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<noscript\\b[^>]*>.*?</noscript>', '', 'g')"
_BLOCKS = "'(?i)</(?:p|div|h[1-6]|li|tr|section|article|blockquote|header|footer)\\s*>|<br\\b[^>]*/?>'"
_LINES = "regexp_replace(regexp_replace(" + _UNESCAPE.format(f"regexp_replace(regexp_replace({_SCRIPTLESS}, {_BLOCKS}, chr(10), 'g'), '<[^>]+>', ' ', 'g')") + ", '[ \\t\\r\\f\\v\\x{a0}]+', ' ', 'g'), '(?m)^ | $', '', 'g')"
_TEXT = f"regexp_replace(regexp_replace({_LINES}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars, len(regexp_extract_all(t, '\\S+')) AS n_words, length(t) > {H.TEXT_CHARS} AS cut_when_stored FROM (SELECT page_id, {_TEXT} AS t FROM pages)")
def page_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each page, and whether a record of it, which has a limit, holds only its beginning."""
    p = table(spark, sf_dir, "pages").select("page_id", H.page_text("html").alias("t"))
    return p.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n_chars"), H.word_count(F.col("t")).cast("long").alias("n_words"), H.stored_text(F.col("t"))["full_text_truncated"].alias("cut_when_stored"))


_STOP = ", ".join(f"'{x}'" for x in H.THEME_STOP_WORDS)


@query(f"""
WITH p AS (SELECT page_id, {_reg(_HOST)} AS site, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} || ' ' ||
  array_to_string([{_plain("x")} FOR x IN regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)][:5], ' ') AS t FROM pages),
w AS (SELECT site, unnest(regexp_extract_all(lower(t), '[a-z][a-z0-9\\-]{{2,}}')) AS token FROM p),
c AS (SELECT site, token, count(*) AS n FROM w WHERE token NOT IN ({_STOP}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, token) AS rn, max(n) OVER (PARTITION BY site) AS top FROM c)
SELECT site, token, n, rn AS place FROM r WHERE CASE WHEN top >= 2 THEN rn <= 25 AND n >= 2 ELSE rn <= 15 END""")
def theme_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.metrics import theme_hints as themes

    p = table(spark, sf_dir, "pages").select(U.registrable(U.host("url")).alias("site"), F.lit("ok").alias("status"), H.title("html").alias("title"), H.h1s("html").alias("h1s"))
    return themes(p, "site")


@query(f"""
WITH p AS (SELECT url, {_reg(_HOST)} AS site, {_PATH} AS path FROM pages),
r AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN path = '/' THEN -1 WHEN regexp_matches(path, '{U.PRIORITY}') THEN 0 ELSE 1 END, length(path), lower(url), url) AS place FROM p)
SELECT site, url, place FROM r WHERE place <= 5""")
def priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.ranking import prioritized

    p = table(spark, sf_dir, "pages").select(U.registrable(U.host("url")).alias("site"), "url")
    return prioritized(p, "site", 5).select("site", "url", F.col("place").cast("long").alias("place"))


@query("""
WITH o AS (SELECT role, lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9'']+')[:4], ' ')) AS opener FROM conversations),
c AS (SELECT role, opener, count(*) AS n FROM o WHERE opener <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, opener) AS rn FROM c)
SELECT role, opener, n FROM r WHERE rn <= 8 AND n > 1""")
def repeated_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.metrics import openers

    return openers(table(spark, sf_dir, "conversations").select(F.col("role").alias("archive"), "text"), "archive").withColumnRenamed("archive", "role")


@query("""
SELECT source, count(*) AS n, CAST(floor(median(length(text))) AS BIGINT) AS median_chars, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS mean_chars
FROM documents WHERE trim(text) <> '' GROUP BY source""")
def digest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.metrics import digest

    return digest(table(spark, sf_dir, "documents").select("source", "text"), "source")


@query(rf"""
SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(c_name), '\b({X.ENTITY_WORDS})\b', '', 'g'), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS company_key,
  coalesce(nullif(left(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'unnamed') AS slug
FROM customer""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.company_key("c_name").alias("company_key"), X.slug("c_name").alias("slug"))


@query("""
WITH p AS (SELECT p_partkey, p_name || ' & Co. Law-Office' AS t FROM part)
SELECT p_partkey, array_to_string(regexp_extract_all(replace(lower(t), '&', ' and '), '\\w+'), ' ') AS word_key,
  trim(regexp_replace(t, '\\s+', ' ', 'g')) AS squeezed FROM p""")
def word_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" & Co. Law-Office")).alias("t"))
    return p.select("p_partkey", X.word_key("t", ampersand=True).alias("word_key"), X.squeezed("t").alias("squeezed"))


_DIGITS = "CASE WHEN c_custkey % 4 = 0 THEN '1' ELSE '' END || '(' || lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') || ') ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 4 END, '0')"


@query(f"""
WITH d AS (SELECT c_custkey, {_DIGITS} AS raw FROM customer), n AS (SELECT *, regexp_replace(raw, '\\D', '', 'g') AS x FROM d),
k AS (SELECT *, CASE WHEN length(x) = 11 AND x[1] = '1' THEN x[2:] ELSE x END AS y FROM n)
SELECT c_custkey, raw, CASE WHEN length(y) = 10 THEN '+1-' || y[1:3] || '-' || y[4:6] || '-' || y[7:] END AS phone FROM k""")
def phone_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_phones(spark, sf_dir).select("c_custkey", "raw", X.phone("raw").alias("phone"))


def _raw_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    last = F.when(k % 7 == 0, F.lpad(k.cast("string"), 3, "0")).otherwise(F.lpad(k.cast("string"), 4, "0"))
    raw = F.concat(F.when(k % 4 == 0, "1").otherwise(""), F.lit("("), F.lpad((k % 900 + 100).cast("string"), 3, "0"), F.lit(") "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"), last)
    return table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.dedup import first_wins

    return first_wins(table(spark, sf_dir, "events"), [F.col("user_id"), F.lower("event_type")], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT o_custkey, max_by(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.dedup import last_wins

    return last_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


_BUSINESS = "SELECT n_name AS category, CASE WHEN c_custkey % 3 = 0 THEN 'personal-injury' ELSE '' END AS practice, CASE WHEN c_custkey % 5 <> 0 THEN 'x' ELSE '' END AS phone, CASE WHEN c_acctbal > 4000 THEN 'https://x.example' ELSE 'n/a' END AS website, CASE WHEN c_mktsegment = 'BUILDING' THEN 'info@x.example' ELSE '' END AS email FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_name").alias("category"), F.when(F.col("c_custkey") % 3 == 0, "personal-injury").otherwise("").alias("practice"), F.when(F.col("c_custkey") % 5 != 0, "x").otherwise("").alias("phone"), F.when(F.col("c_acctbal") > 4000, "https://x.example").otherwise("n/a").alias("website"), F.when(F.col("c_mktsegment") == "BUILDING", "info@x.example").otherwise("").alias("email"))


_SCORES = """
s AS (SELECT category, count(*) AS notes, count(*) FILTER (phone <> '') AS with_phone, count(*) FILTER (website <> 'n/a') AS with_website, count(*) FILTER (email <> '') AS with_email,
  count(*) FILTER (practice = 'personal-injury') AS practice_notes, count(*) FILTER (practice = 'personal-injury' AND website <> 'n/a') AS practice_with_website,
  count(*) FILTER (practice = 'personal-injury' AND phone <> '') AS practice_with_phone FROM b GROUP BY category)"""


@query(f"""
WITH b AS ({_BUSINESS}), {_SCORES}
SELECT *, round(CASE WHEN notes = 0 THEN 0 ELSE with_website / notes END, 6) AS site_fill,
  round(CASE WHEN practice_notes = 0 THEN 0 ELSE practice_with_website / practice_notes END, 6) AS practice_site_fill FROM s""")
def coverage_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.metrics import scorecard

    s = scorecard(_businesses(spark, sf_dir), "personal-injury")
    return s.withColumn("site_fill", F.round("site_fill", 6)).withColumn("practice_site_fill", F.round("practice_site_fill", 6))


_THRESHOLDS = "(VALUES ('FRANCE', false, 40, 0.5, NULL), ('GERMANY', true, 80, 0.4, 'bulk-nppes'), ('BRAZIL', true, 1000, 0.3, NULL), ('CHINA', false, 100000, 0.9, NULL), ('JAPAN', false, 1, 0.0, NULL), ('CANADA', false, 1, 0.99, NULL)) t(category, specialty_required, min_notes, min_site_fill, specialty_mode)"


@query(f"""
WITH b AS ({_BUSINESS}), {_SCORES}, j AS (SELECT s.category, notes, round(with_website / notes, 6) AS fill, t.category IS NULL AS missing, specialty_required AS sr, min_notes AS mn, min_site_fill AS mf, specialty_mode AS sm FROM s LEFT JOIN {_THRESHOLDS} USING (category))
SELECT category, CASE WHEN NOT missing AND notes >= mn AND fill >= mf THEN 'COVERED' ELSE 'NOT COVERED' END AS verdict,
  CASE WHEN missing THEN 'no matrix row' ELSE concat_ws('; ', CASE WHEN notes < mn THEN 'notes' END, CASE WHEN fill < mf THEN 'site_fill' END) END AS reasons,
  CASE WHEN missing THEN 'coverage-check' WHEN notes < mn THEN CASE WHEN sr THEN coalesce(sm, 'specialty-directory') ELSE 'bulk-dump' END WHEN fill < mf THEN 'enrich' ELSE '' END AS next_mode FROM j""")
def threshold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.metrics import scorecard, verdicts

    rows = [("FRANCE", False, 40, 0.5, None), ("GERMANY", True, 80, 0.4, "bulk-nppes"), ("BRAZIL", True, 1000, 0.3, None), ("CHINA", False, 100000, 0.9, None), ("JAPAN", False, 1, 0.0, None), ("CANADA", False, 1, 0.99, None)]
    limits = spark.createDataFrame(rows, "category string, specialty_required boolean, min_notes int, min_site_fill double, specialty_mode string")
    return verdicts(scorecard(_businesses(spark, sf_dir)), limits)


@query("""
WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'click' THEN 3 ELSE 0 END + CASE WHEN value > 50 THEN 2 ELSE 0 END - CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS score FROM events)
SELECT user_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rn FROM s) WHERE rn = 1""")
def additive_score_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.ranking import top

    kind = F.col("event_type")
    score = F.when(kind == "purchase", 5).when(kind == "signup", 4).when(kind == "click", 3).otherwise(0) + F.when(F.col("value") > 50, 2).otherwise(0) - F.when(kind == "error", 3).otherwise(0)
    return top(table(spark, sf_dir, "events").select("user_id", "event_id", score.alias("score")), ["user_id"], [F.desc("score"), F.asc("event_id")]).select("user_id", "event_id", "score")


@query("""
SELECT n_name AS category, c_name AS name, c_acctbal AS score, place FROM (
  SELECT n_name, c_name, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_name) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) WHERE place <= 10""")
def shortlist_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.ranking import top

    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 0")
    c = c.select(F.col("n_name").alias("category"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return top(c, ["category"], [F.desc("score"), F.asc("name")], 10).withColumn("place", F.col("place").cast("long"))


@query("""
WITH old AS (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS text, value AS favorite_count FROM events),
new AS (SELECT CASE WHEN event_type = 'click' THEN -1 - event_id ELSE event_id END AS id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text, CASE WHEN value < 10 THEN value + 1 ELSE value END AS favorite_count FROM events)
SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(o.text, ''), n.text, o.text) AS text, coalesce(n.favorite_count, o.favorite_count) AS favorite_count,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NOT NULL AND (n.favorite_count IS DISTINCT FROM o.favorite_count OR (o.text = '' AND n.text <> '')) THEN 'updated' ELSE 'same' END AS change
FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are known posts; all come again, clicks as posts of their own, some with other numbers or texts."""
    from gleanery.operators.merge import upsert_posts

    e, i, kind, value = table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type"), F.col("value")
    old = e.select(i.alias("id"), F.when(kind == "view", "").otherwise(kind).alias("text"), value.alias("favorite_count"))
    new = e.select(F.when(kind == "click", -1 - i).otherwise(i).alias("id"), F.when(kind == "error", "").otherwise(kind).alias("text"), F.when(value < 10, value + 1).otherwise(value).alias("favorite_count"))
    return upsert_posts(old, new, ["id"], fill=["text"], metrics=["favorite_count"]).select("id", "text", "favorite_count", "change")


@query("SELECT user_id, event_type, list_sort(list(DISTINCT CAST(ts AS DATE))) AS days FROM events GROUP BY ALL")
def multimap_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.metrics import multimap

    return multimap(table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day")), ["user_id", "event_type"], "day", "days")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = s_nationkey AND r_name = 'ASIA')")
def allowed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    s = table(spark, sf_dir, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left_semi").select("s_suppkey", "s_name")


@query("SELECT DISTINCT o_custkey AS slug FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM orders q WHERE q.o_custkey = orders.o_custkey AND q.o_orderstatus = 'F')")
def queue_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.merge import not_queued

    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("slug")).distinct()
    return not_queued(new, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("slug")), ["slug"])


@query(r"""
WITH w AS (SELECT DISTINCT p_brand AS firm FROM part), k AS (SELECT firm, trim(regexp_replace(regexp_replace(upper(firm), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM w),
n AS (SELECT p_partkey, p_name, trim(regexp_replace(regexp_replace(upper(p_brand || ' ' || p_name), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS name_key FROM part)
SELECT firm, min(p_partkey) AS p_partkey FROM k JOIN n ON strpos(name_key, key) > 0 OR strpos(key, name_key) > 0 WHERE length(key) >= 5 GROUP BY firm""")
def containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.entities import contained_match

    p = table(spark, sf_dir, "part")
    w = p.select(F.col("p_brand").alias("firm")).distinct().withColumn("key", X.company_key("firm"))
    n = p.select(F.col("p_partkey").alias("ord"), X.company_key(F.concat_ws(" ", "p_brand", "p_name")).alias("name_key"))
    return contained_match(w, n, "key", "name_key", ["firm"]).select("firm", F.col("ord").alias("p_partkey"))


@query("""
WITH s AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS previous,
  last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_success
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type, coalesce(previous, '') AS previous, coalesce(last_success, -1) AS last_success FROM s WHERE event_type = 'error'""")
def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.hiring import with_history

    e = with_history(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"), F.col("event_type").isin("purchase", "signup"), F.col("event_id"))
    return e.where("event_type = 'error'").select("user_id", "event_id", "event_type", F.coalesce("previous_status", F.lit("")).alias("previous"), F.coalesce("last_success", F.lit(-1)).alias("last_success"))


@query("""
WITH p AS (SELECT user_id AS archive_id, CAST(date_trunc('day', ts) AS DATE) AS page, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS progress FROM events GROUP BY ALL),
g AS (SELECT *, sum(progress) OVER (PARTITION BY archive_id ORDER BY page) AS run FROM p),
s AS (SELECT *, count(*) FILTER (progress = 0) OVER (PARTITION BY archive_id, run ORDER BY page ROWS UNBOUNDED PRECEDING) AS streak FROM g)
SELECT archive_id, min(page) AS stopped_at FROM s WHERE streak >= 5 GROUP BY archive_id""")
def dup_streak_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.streaming.archive import exhausted_at

    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("archive_id"), F.date_trunc("day", "ts").cast("date").alias("page")).agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("progress"))
    return exhausted_at(e, "archive_id", "page", "progress").withColumnRenamed("page", "stopped_at")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(f"SELECT path, n FROM (SELECT {_PATH} AS path, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, path LIMIT 40")
def path_counts_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").groupBy(U.path("url").alias("path")).agg(F.count("*").alias("n"))
    return p.orderBy(F.desc("n"), "path").limit(40)


@query(f"SELECT {_reg(_HOST)} AS site, count(*) FILTER (length(html) > 3000) AS ok, count(*) FILTER (length(html) <= 3000 AND length(html) > 2500) AS timeout, count(*) FILTER (length(html) <= 2500 AND length(html) > 2000) AS http_error, count(*) FILTER (length(html) <= 2000) AS error, count(*) AS total FROM pages GROUP BY 1")
def site_page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.metrics import outcome_counts

    n = F.length("html")
    p = table(spark, sf_dir, "pages").select(U.registrable(U.host("url")).alias("site"), F.when(n > 3000, "ok").when(n > 2500, "timeout").when(n > 2000, "http_error").otherwise("error").alias("status"))
    return outcome_counts(p, ["site"])


@query(f"""
WITH l AS (SELECT page_id, {_HOST} AS host, unnest(regexp_extract_all(html, 'href=["'']([^"''#]+)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=["'']([^"''#]+)["'']', 1), 1) AS pos,
  regexp_extract(url, '^[a-z]+', 0) AS scheme FROM pages),
k AS (SELECT page_id, scheme || '://' || host || href AS link, lower(regexp_replace(scheme || '://' || host || href, '/+$', '')) AS key, pos FROM l WHERE href LIKE '/%'),
f AS (SELECT page_id, key, min_by(link, pos) AS link, min(pos) AS pos FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM f)
SELECT page_id, place, link FROM r WHERE place <= 12""")
def same_site_links_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.operators.pages import same_site_links

    return same_site_links(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id").select("page_id", F.col("place").cast("long").alias("place"), "link")


@query("""
WITH p AS (SELECT s_suppkey AS slug, s_nationkey, n_regionkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT *, CASE WHEN rn >= n_regionkey + 1 THEN rn + 1 ELSE rn END AS free FROM p)
SELECT slug, 'n' || s_nationkey || CASE WHEN free > 1 THEN '-' || free ELSE '' END AS file FROM f""")
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are named after their nation; the name with the region's number plus one is taken already."""
    from gleanery.operators.entities import unique_slugs

    n = table(spark, sf_dir, "nation")
    taken = n.select(F.concat(F.lit("n"), F.col("n_nationkey"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("-"), F.col("n_regionkey") + 1)).otherwise("")).alias("slug"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("base"))
    return unique_slugs(s, "base", ["slug"], taken).select("slug", F.col("unique_slug").alias("file"))


@query("""
WITH a AS (SELECT p_partkey::VARCHAR AS path, md5(p_name) AS h FROM part), b AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN 'old-' ELSE '' END || p_partkey AS path, md5(CASE WHEN p_size > 25 THEN p_name || '!' ELSE p_name END) AS h FROM part)
SELECT count(*) FILTER (a.path IS NOT NULL AND a.h IS DISTINCT FROM b.h) AS copied, count(*) FILTER (a.path IS NULL) AS removed, count(*) FILTER (a.path IS NOT NULL) AS total FROM a FULL JOIN b ON a.path = b.path""")
def mirror_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy of all parts has some under old names, others with another content."""
    from gleanery.operators.merge import mirror_counts

    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    a = p.select(k.alias("path"), F.col("p_name").cast("binary").alias("content"))
    b = p.select(F.concat(F.when(F.col("p_type") == "ECONOMY", "old-").otherwise(""), k).alias("path"), F.when(F.col("p_size") > 25, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).cast("binary").alias("content"))
    return mirror_counts(a, b)


