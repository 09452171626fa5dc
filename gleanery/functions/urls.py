"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import FREE_MAIL, _c, filled, let
from gleanery.functions.unicode import idna_host, url_join

# Fixed values.
TWO_PART_SUFFIXES = "co.uk com.au co.nz co.jp com.br co.za com.mx org.uk net.au".split()
DIRECTORY_HOSTS = "justia.com findlaw.com lawyers.com avvo.com facebook.com yelp.com linkedin.com superpages.com google.com maps.google yellowpages.com bbb.org wikipedia.org wixsite.com martindale.com usattorneys.com".split()
PRIORITY = r"(?i)/(contact|about|team|our-team|people|staff|attorney|attorneys|bio|bios|lawyer|lawyers|our-firm|meet|leadership|partners?|members?|blog|post|posts|service|services|practice|practices|pricing|faq|case|cases|success|success-stories|case-studies?)(/|$)"
#: Those of the e-mail crawl.
MAIL_PRIORITY = r"(?i)/(contact|about|team|our-team|people|staff|attorney|attorneys|bio|bios|lawyer|lawyers|our-firm|meet|leadership|partners?|members?)(/|$)"


def with_scheme(url: Column | str) -> Column:
    u = filled(url)
    return F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def authority(url: Column | str) -> Column:
    """Host and port in lower case, with user information; '' if there is none."""
    return F.lower(F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column | str) -> Column:
    """Host and port in lower case."""
    return F.regexp_replace(authority(url), "^.*@", "")


def path(url: Column | str) -> Column:
    """The path, '/' if empty; query and fragment are no part of it."""
    p = F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(p, F.lit("")), F.lit("/"))


def registrable(domain: Column | str) -> Column:
    """The domain one would register: the last two labels, three before a two-part suffix."""
    h = F.regexp_replace(F.regexp_replace(F.trim(F.lower(_c(domain))), r"\.+$", ""), r"^www\.", "")

    def last(labels):
        n = F.size(labels)
        tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), F.lit(k)), ".")
        return F.when(n < 2, F.array_join(labels, ".")).when((n >= 3) & tail(2).isin(TWO_PART_SUFFIXES), tail(3)).otherwise(tail(2))

    return let(F.split(h, r"\."), last)


def same_site(mail_domain: Column | str, site: Column | str) -> Column:
    """Equal registrable domains; a free-mail domain is only the same as itself."""
    a, b = registrable(mail_domain), registrable(site)
    return F.coalesce((a != "") & (a == b), F.lit(False))


def is_free_mail(domain: Column | str) -> Column:
    return registrable(domain).isin(FREE_MAIL)


def normalized(url: Column | str, base: Column | str | None = None) -> Column:
    """Scheme and host in lower case, no query or fragment, '/' for an empty path."""
    u = filled(url) if base is None else url_join(_c(base), filled(url))
    scheme = lambda x: F.coalesce(F.nullif(F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("")), F.lit("https"))
    return let(u, lambda x: F.concat(scheme(x), F.lit("://"), authority(x), path(x)))


def origin(url: Column | str) -> Column:
    scheme = F.lower(F.regexp_extract(with_scheme(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.concat(scheme, F.lit("://"), authority(url))


def crawl_key(url: Column | str) -> Column:
    """What makes two addresses one page."""
    return F.lower(F.regexp_replace(_c(url), "/+$", ""))


def host_slug(url_host: Column | str) -> Column:
    h = F.regexp_replace(F.lower(_c(url_host)), r"^www\.", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(h, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("site"))


def is_directory(url: Column | str, exact: bool = False) -> Column:
    """Whether the host belongs to a business directory. By default any host that contains a listed name; exact: the name or a host under it."""
    h = host(url)
    pattern = "|".join(x.replace(".", r"\.") for x in DIRECTORY_HOSTS)
    hit = h.rlike(rf"(^|\.)({pattern})(:\d+)?$") if exact else h.rlike(pattern)
    return F.coalesce(hit, F.lit(True))


def is_priority(url: Column | str, mail: bool = False) -> Column:
    return path(url).rlike(MAIL_PRIORITY if mail else PRIORITY)


def query_value(url: Column | str, key: str) -> Column:
    """The decoded value of one query key; null if it is missing, repeated or can't be decoded."""
    q = F.regexp_extract(_c(url), r"\?([^#]*)", 1)
    found = F.regexp_extract_all(q, F.lit(rf"(?:^|&){key}=([^&]*)"), 1)
    return F.when(F.size(found) == 1, F.try_url_decode(F.regexp_replace(found[0], "^$", "")))


def board_url(url: Column | str, kind: str = "company") -> Column:
    """The canonical address of a company (or person: kind "in") on the first board; null for deceptive hosts, ports and credentials."""
    u = F.trim(filled(url))
    tail = {"company": "(?:/(?:jobs/?)?)?", "in": "/?"}[kind]
    path = F.try_url_decode(F.regexp_replace(F.regexp_extract(u, r"(?i)^https://(?:www\.|[a-z]{2,3}\.)?linkedin\.com(?::443)?(/[^?#\s]*)", 1), r"\+", "%2B"))
    name = F.regexp_extract(path, rf"^/{kind}/([\p{{L}}\p{{N}}_-]+){tail}$", 1)
    return F.when((name != "") & ~u.rlike(r"[\x00-\x20\x7f\\]"), F.concat(F.lit(f"https://www.linkedin.com/{kind}/"), F.lower(name), F.lit("/")))


def second_board_url(url: Column | str) -> Column:
    """The canonical address of a company on the second board; regional hosts stay."""
    u = filled(url)
    pattern = r"(?i)^https://((?:[a-z]{2,3}\.|www\.)?indeed\.com)/cmp/([A-Za-z0-9%_.-]+)/?(?:[?#].*)?$"
    return F.when(u.rlike(pattern), F.concat(F.lit("https://"), F.lower(F.regexp_extract(u, pattern, 1)), F.lit("/cmp/"), F.regexp_extract(u, pattern, 2)))


def company_ref(url: Column | str, source: Column | str) -> Column:
    return F.when(_c(source) == "linkedin", board_url(url)).when(_c(source) == "indeed", second_board_url(url))


def job_identity(url: Column | str, source: str) -> Column:
    """job_id and canonical address of a job; null if the address names none, or two."""
    u = filled(url)
    if source == "linkedin":
        found = F.regexp_extract(u, r"(?i)^https?://(?:[a-z]{2,3}\.|www\.)?linkedin\.com/jobs/view/(?:[^/?#]*?-)?(\d{6,})/?(?:[?#].*)?$", 1)
        return F.when(found != "", F.struct(found.alias("job_id"), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), found).alias("url")))
    h = F.regexp_extract(u, r"(?i)^https://((?:[a-z]{2,3}\.|www\.)?indeed\.com)/", 1)
    key = F.lower(F.coalesce(query_value(u, "jk"), query_value(u, "vjk")))
    return F.when((h != "") & key.rlike("^[0-9a-f]{16}$"), F.struct(key.alias("job_id"), F.concat(F.lit("https://"), F.lower(h), F.lit("/viewjob?jk="), key).alias("url")))


def official_host(url: Column | str, shared: list[str] | None = None) -> Column:
    """The exact host of a firm's own site without www; null for addresses by number, shared hosts, credentials and odd ports."""
    a = authority(url)
    h = F.regexp_replace(F.regexp_replace(idna_host(F.regexp_replace(a, r":(80|443)$", "")), r"\.+$", ""), r"^www\.", "")
    ok = ~a.contains("@") & ~h.contains(":") & h.contains(".") & ~h.rlike(r"^\d+(\.\d+){3}$|^\[") & ~h.rlike("|".join(x.replace(".", r"\.") for x in (shared or DIRECTORY_HOSTS)))
    return F.when(ok, h)


def outbound(url: Column | str) -> Column:
    """What a board's redirect leads to, or the address itself."""
    return F.coalesce(query_value(url, "url"), filled(url))


def safe_link(url: Column | str) -> Column:
    """A public http(s) address, or null: no local or private hosts, no numbers, no credentials."""
    u, h = filled(url), host(url)
    bad = h.rlike(r"^(localhost|.*\.(local|internal|localhost))(:\d+)?$|^[\d.]+(:\d+)?$|^\[") | authority(url).contains("@")
    return F.when(u.rlike("(?i)^https?://") & h.contains(".") & ~bad, u)


def operation(url: Column | str) -> Column:
    """query_id and operation from a path .../graphql/<query id>/<operation>."""
    pattern = r"/graphql/([^/?#]+)/([^/?#]+)"
    return F.when(_c(url).rlike(pattern), F.struct(F.regexp_extract(_c(url), pattern, 1).alias("query_id"), F.regexp_extract(_c(url), pattern, 2).alias("operation")))


def template(url: Column | str) -> Column:
    """The address without query and fragment."""
    return F.regexp_replace(_c(url), r"[?#].*$", "")
