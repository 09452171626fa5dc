"""Names, phones, e-mail addresses, slugs and other scalars, as column expressions.

A missing string is '' in landed data and may be null here; functions treat both alike
and return null for "nothing" unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.unicode import ascii_fold, html_unescape, nfkc_casefold

# Fixed values.
ENTITY_WORDS = "INCORPORATED|INC|LLC|L\\.L\\.C|CO|COMPANY|CORP|CORPORATION|LTD|LP|PLLC|PC|P\\.C|PA|P\\.A|THE|FOUNDATION|CHURCH|MINISTRIES|DBA|ATTORNEY|ATTORNEYS|LAW|FIRM|OFFICE|OFFICES"
ROLE_INBOXES = (
    "info contact office admin hello marketing intake intakes team support frontdesk reception noreply no-reply donotreply webmaster media press hr billing accounting careers jobs help service services general mail email enquiries inquiry inquiries"
).split()
FREE_MAIL = "gmail.com yahoo.com yahoo.co.uk hotmail.com outlook.com live.com msn.com aol.com icloud.com me.com mac.com protonmail.com proton.me gmx.com mail.com ymail.com googlemail.com".split()
ASSET_ENDINGS = ".png .jpg .jpeg .gif .svg .webp .css .js".split()
BEST_INBOXES = "info contact office admin hello intake frontdesk".split()
NAME_STOP_WORDS = "the and of at law firm office offices attorney attorneys lawyer lawyers associate associates partner partners president founder managing".split()
NAME_TOPIC_WORDS = "accident|injury|truck|car|wrongful|death|practice|areas?|attorneys?|lawyers?|positions?|past|meet|our|team|staff|privacy|policy|contact|about|home|blog|news|results?|testimonials?|faq|services?|free|consultation"
FIRM_WORDS = "law\\s+firm|law\\s+office|pllc|p\\.?c\\.?|llp|llc|associates|group|legal|attorneys?\\s+at\\s+law|company|title|escrow"
THEME_SKIPPED = "the and for with from that this your our you are was were will can has have had not but all any how who what when where why its into a an of to in on at by or as is be".split()
WEBSITE_BLANKS = "n/a none na null -".split()

EMAIL = r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
MAILTO = r"(?i)mailto:([^\s\"'<>?#]+)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column | str, f) -> Column:
    """f of a value that is computed once, however often f uses it; else nested functions grow with every use."""
    return F.element_at(F.transform(F.array(_c(x)), f), 1)


def filled(x: Column | str) -> Column:
    """The trimmed value, null where nothing is left."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first of several values that isn't missing, trimmed."""
    return F.coalesce(*[filled(x) for x in xs])


def joined(separator: str, *xs: Column | str) -> Column:
    """Values that aren't missing, joined."""
    return F.concat_ws(separator, *[filled(x) for x in xs])


def squeezed(x: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def digits(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"\D", "")


def phone(x: Column | str) -> Column:
    """+1-AAA-EEE-NNNN of a ten-digit number, with or without a leading 1; else null."""
    d = digits(_c(x).cast("string"))
    return F.when(d.rlike(r"^1?\d{10}$"), F.regexp_replace(d, r"^1?(\d{3})(\d{3})(\d{4})$", "+1-$1-$2-$3"))


def area_code(formatted: Column | str) -> Column:
    return F.substring(_c(formatted), 4, 3)


def preferred_phone(phones: Column | str, local: list[str]) -> Column:
    """From an array: the first number with a local area code, else the first."""
    known = F.filter(F.transform(_c(phones), phone), lambda p: p.isNotNull())
    near = F.filter(known, lambda p: area_code(p).isin(local)) if local else F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(near, F.lit(1)), F.try_element_at(known, F.lit(1)))


def company_key(x: Column | str, fold: bool = True) -> Column:
    """The name as it is compared: ASCII capitals and digits, without legal and entity words; '' if nothing is left."""
    s = F.upper(ascii_fold(_c(x)) if fold else _c(x))
    s = F.regexp_replace(s, rf"\b({ENTITY_WORDS})\b", "")
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(s, "[^A-Z0-9 ]+", " "), " +", " ")), F.lit(""))


def word_key(x: Column | str, ampersand: bool = False) -> Column:
    """Case-folded words joined by a blank; business words stay."""
    s = nfkc_casefold(_c(x))
    s = F.regexp_replace(s, "&", " and ") if ampersand else s
    return F.coalesce(F.array_join(F.regexp_extract_all(s, F.lit(r"(?U)(\w+)"), 1), " "), F.lit(""))


def slug(x: Column | str, default: str = "unnamed", most: int = 80, fold: bool = True) -> Column:
    s = F.lower(ascii_fold(_c(x)) if fold else _c(x))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit(default))


def title_case(x: Column | str) -> Column:
    """Each run of letters with a capital first, also after apostrophes and hyphens."""
    parts = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**30))), "")


def city_name(x: Column | str, default: str = "Texas") -> Column:
    return F.coalesce(title_case(filled(x)), F.lit(default))


def city_of_source(url: Column | str, default: str = "Texas") -> Column:
    """The path part before /texas or /tx of a directory's address."""
    found = F.nullif(F.regexp_extract(F.lower(_c(url)), r"/([^/]+)/(texas|tx)\b", 1), F.lit(""))
    return city_name(F.regexp_replace(found, "-", " "), default)


def address_text(street: Column, locality: Column, region: Column, postal: Column) -> Column:
    return joined(", ", street, locality, region, postal)


def email_local(email: Column | str) -> Column:
    return F.trim(F.lower(F.split_part(_c(email), F.lit("@"), F.lit(1))))


def email_domain(email: Column | str) -> Column:
    return F.lower(F.split_part(_c(email), F.lit("@"), F.lit(2)))


def is_role_inbox(email: Column | str) -> Column:
    local = email_local(email)
    head = F.split_part(F.split_part(local, F.lit("."), F.lit(1)), F.lit("+"), F.lit(1))
    return F.coalesce(local.isin(ROLE_INBOXES) | head.isin(ROLE_INBOXES), F.lit(False))


def is_personal_email(email: Column | str) -> Column:
    """Whether the local part has the shape of a person's name."""
    local = email_local(email)
    shape = local.rlike(r"^[a-z]{1,20}[._-][a-z]{1,20}$") | local.rlike(r"^[a-z]\.?[a-z]{2,20}$") | local.rlike("^[a-z]{3,30}$")
    return F.coalesce(_c(email).contains("@") & ~is_role_inbox(email) & (F.length(local) >= 2) & shape, F.lit(False))


def personal_email_bonus(email: Column | str) -> Column:
    """3, 2 or 0 by the shape of the local part."""
    local = email_local(email)
    bonus = F.when(local.rlike(r"^[a-z]+\.[a-z]+$"), 3).when(local.rlike("^[a-z]{2,}$") & (F.length(local) >= 5), 2).when(local.rlike("^[a-z]{3,}$"), 2).when(is_personal_email(email), 3).otherwise(0)
    return F.when(filled(email).isNull() | is_role_inbox(email), 0).otherwise(bonus)


def email_kind(email: Column | str) -> Column:
    return F.when(is_role_inbox(email), "role").when(is_personal_email(email), "personal").otherwise("other")


def _no_asset(e: Column) -> Column:
    return ~reduce(lambda a, b: a | b, [F.endswith(e, F.lit(x)) for x in ASSET_ENDINGS])


def clean_email(x: Column | str) -> Column:
    """A usable address in lower case, or null: no assets, no blanks, no free mail."""
    e = F.try_url_decode(F.regexp_replace(F.trim(html_unescape(_c(x))), r"\+", "%2B"))
    e = F.regexp_replace(F.trim(F.split_part(e, F.lit("?"), F.lit(1))), r"[.,;:)>\]\"']+$", "")
    e = F.lower(F.regexp_replace(e, "%40", "@"))
    fine = e.rlike(r"^[^@ ]+@[^@ ]*\.[^@ ]*$") & _no_asset(e) & ~email_domain(e).isin(FREE_MAIL)
    return F.when(fine, e)


def emails_in(text: Column | str, unescape: bool = True) -> Column:
    """Addresses in a text, mailto links first, then in order, each once, in lower case."""
    t = html_unescape(_c(text)) if unescape else _c(text)
    linked = F.transform(F.regexp_extract_all(t, F.lit(MAILTO), 1), lambda m: F.lower(F.regexp_replace(F.trim(m), "%40", "@")))
    plain = F.transform(F.regexp_extract_all(t, F.lit(EMAIL), 1), lambda m: F.regexp_replace(F.lower(m), r"[.,;:)>\]]+$", ""))
    return F.array_distinct(F.concat(F.filter(linked, lambda e: e.contains("@")), F.filter(plain, _no_asset)))


def name_of_email(local: Column | str, initials: bool = False) -> Column:
    """A display name from first.last; with initials also "F. Last" from flast, which invents people and is off."""
    x = F.lower(_c(local))
    parts = F.filter(F.split(x, r"\."), lambda p: p.rlike(r"^\p{L}+$") & (F.length(p) > 1) & (F.length(p) < 20))
    full = F.when(x.contains(".") & (F.size(parts) >= 2), F.array_join(F.transform(F.slice(parts, 1, 3), F.initcap), " "))
    short = F.when(x.rlike("^[a-z][a-z]{2,19}$"), F.concat(F.upper(F.substring(x, 1, 1)), F.lit(". "), F.initcap(F.substring(x, 2, 100))))
    return F.when(~x.isin(ROLE_INBOXES), F.coalesce(full, short) if initials else full)


def is_person_name(name: Column | str, firm: Column | str | None = None) -> Column:
    """Two to four words that look like a person's name, and not like the firm's or a topic's."""
    n = squeezed(name)
    stop = "|".join(NAME_STOP_WORDS)
    ok = F.length(n).between(3, 80) & n.rlike(r"^[A-Za-z][A-Za-z'.-]*( [A-Za-z][A-Za-z'.-]*){1,3}$")
    ok &= ~n.rlike(rf"(?i)((^| )({stop})\.*( |$)|\b({NAME_TOPIC_WORDS})\b|\b({FIRM_WORDS})\b)")
    if firm is not None:
        ok &= F.lower(n) != F.coalesce(F.lower(F.trim(_c(firm))), F.lit(""))
    return F.coalesce(ok, F.lit(False))


def name_forms(name: Column | str) -> Column:
    """The local parts that the first and last word of a name can make: as they are behind "=", without dots and underscores behind "~"."""
    tokens = F.filter(F.transform(F.regexp_extract_all(_c(name), F.lit("([A-Za-z]+)"), 1), lambda t: F.lower(t)), lambda t: F.length(t) > 1)
    dot = F.lit(".")

    def forms(parts):
        first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
        initial = F.substring(first, 1, 1)
        made = F.array(F.concat(first, last), F.concat(first, dot, last), F.concat(first, F.lit("_"), last), F.concat(initial, last), F.concat(initial, dot, last), F.concat(last, first), F.concat(last, dot, first))
        every = let(made, lambda x: F.concat(F.transform(x, lambda y: F.concat(F.lit("="), y)), F.transform(x, lambda y: F.concat(F.lit("~"), F.regexp_replace(y, "[._]", "")))))
        return F.when(F.size(parts) >= 2, F.array_distinct(every))

    return F.coalesce(let(tokens, forms), F.array().cast("array<string>"))


def address_forms(email: Column | str) -> Column:
    """The forms of a name that an address fits: its local part, and, behind "~", that without hyphens. None for shared inboxes."""
    local = email_local(email)
    every = F.array(F.concat(F.lit("="), local), F.concat(F.lit("~"), F.regexp_replace(local, "-", "")))
    return F.when(F.coalesce(_c(email).contains("@") & ~is_role_inbox(email), F.lit(False)), every).otherwise(F.array().cast("array<string>"))


def name_fits_email(name: Column | str, email: Column | str) -> Column:
    """Whether a local part is built from the first and last word of a name."""
    return F.coalesce(F.arrays_overlap(name_forms(name), address_forms(email)), F.lit(False))


def best_inbox(emails: Column | str) -> Column:
    """Of an array: the address of the most wanted inbox (the last of equal ones), else the first that starts like one, else the first."""
    e = _c(emails)
    named = lambda b: F.filter(e, lambda x: F.split_part(x, F.lit("@"), F.lit(1)) == b)
    begun = lambda b: F.filter(e, lambda x: x.startswith(b))
    exact = [F.try_element_at(named(b), F.lit(-1)) for b in BEST_INBOXES]
    alike = [F.try_element_at(begun(b), F.lit(1)) for b in BEST_INBOXES]
    return F.coalesce(*exact, *alike, F.try_element_at(e, F.lit(1)))


def opener(text: Column | str, n: int = 4) -> Column:
    """The first words in lower case."""
    return F.lower(F.array_join(F.slice(F.regexp_extract_all(_c(text), F.lit("([A-Za-z0-9']+)"), 1), 1, n), " "))


def handle(x: Column | str) -> Column:
    """A name without @, null unless it has 1 to 15 letters, digits or underscores."""
    h = F.regexp_replace(F.trim(_c(x)), "^@+", "")
    return F.when(h.rlike("^[A-Za-z0-9_]{1,15}$"), h)


def lenient_int(x: Column | str) -> Column:
    """A whole number from text or number, through a double; null if it is none."""
    return _c(x).try_cast("double").try_cast("bigint")


def website_value(x: Column | str) -> Column:
    w = filled(x)
    return F.when(~F.lower(w).isin(WEBSITE_BLANKS), w)


def theme_words(themes: Column | str, stop: list[str] = THEME_SKIPPED, n: int = 8) -> Column:
    """Themes without their counts, stop words and short words; the first n."""
    words = F.transform(_c(themes), lambda t: F.trim(F.regexp_replace(t, r"\s*\(\d+\)\s*$", "")))
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(stop)), 1, n)


def stripped_tags(x: Column | str) -> Column:
    """Text of a fragment: scripts, styles and tags become blanks, references are decoded first."""
    s = html_unescape(_c(x))
    s = F.regexp_replace(s, r"(?is)<(script|style).*?>.*?</\1>", " ")
    return squeezed(F.regexp_replace(s, r"<[^>]+>", " "))


def stamp(ts: Column | str, pattern: str = "yyyy-MM-dd", zone: str = "America/Chicago") -> Column:
    """A UTC time in the archive's own zone, as text."""
    return F.date_format(F.from_utc_timestamp(_c(ts), zone), pattern)
