"""What a page says, as a flat list of statements, so that rules about it are column expressions.

A statement has a topic and a subject (a number inside the topic), a predicate and an object:

topic      subject      predicate                    object            link
asked      0            -                            -                 the page's own address
canonical  node         -                            -                 href
heading    node         tag                          text              -
term       node         the <dt>, lower case         text of its <dd>  each href in the <dd>, or none
anchor     node         test ids and label, lower    text              href
section    node         data-test-id                 first <h2>        -
card       section      subtitle                     title             href of a person, in a section
org        document     a name, an address or link   value             value, for links

An organisation is an object at the top of a JSON-LD document, in its @graph or its mainEntity;
what is nested in reviews and the like says nothing of the page's firm. foreign: the statement
stands in a part of the page that speaks of others. Links are resolved once, into the company
they name on the board asked for, and the own site they lead to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import board_links as L
from gleanery.functions.arrow import rowwise
from gleanery.functions.dom import Dom

# Fixed values.
ORGANISATIONS = ("Organization", "Corporation", "LocalBusiness", "LegalService", "ProfessionalService", "MedicalOrganization", "EducationalOrganization", "NGO")
ORG_NAMES, ORG_LINKS, ORG_MORE = ("name", "legalName", "alternateName"), ("url", "@id", "sameAs"), ("@graph", "mainEntity")
CARD_CLASSES = frozenset(("base-main-card", "base-card"))
CARD_TITLES, CARD_SUBTITLES = ("base-main-card__title", "base-card__title"), ("base-main-card__subtitle", "base-card__subtitle")
MARKS = ("data-testid", "data-test-id", "aria-label")

_TEXTS = ("topic", "predicate", "object", "key", "absolute", "company", "site", "host", "person", "number", "image")
STATEMENT = T.StructType([T.StructField("subject", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in _TEXTS], T.StructField("foreign", T.BooleanType()), T.StructField("edge", T.BooleanType())])


def listed(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _terms(dom: Dom) -> Iterator[tuple[int, str, str, list[str]]]:
    """Nodes of <dt>, their labels, and texts and links of the <dd> that follow at once."""
    for around in range(len(dom.tag)):
        inner = [k for k in dom.kids[around] if isinstance(k, int)]
        for a, b in zip(inner, inner[1:], strict=False):
            if (dom.tag[a], dom.tag[b]) == ("dt", "dd"):
                yield a, dom.text(a).lower().strip(": "), dom.text(b), [dom.attrs[n].get("href", "") for n in dom.below(b) if dom.tag[n] == "a"]


def _cards(dom: Dom, section: int) -> Iterator[tuple[str, str, str, str]]:
    """Link, title, subtitle and image of the cards in a section. A link's card is the nearest list item, article or box of a card class around it."""
    for n in dom.below(section):
        if dom.tag[n] == "a":
            around = [a for a in dom.above(n) if a > section and (dom.tag[a] in ("li", "article") or CARD_CLASSES & set(dom.attrs[a].get("class", "").split()))]
            card = around[0] if around else n
            pictures = [dom.attrs[i].get("data-delayed-url") or dom.attrs[i].get("src", "") for i in dom.find(card, tags=("img",))]
            yield dom.attrs[n].get("href", ""), dom.first_text(card, classes=CARD_TITLES, tags=("h3",)) or dom.text(n), dom.first_text(card, classes=CARD_SUBTITLES, tags=("h4",)), "".join(pictures[:1])


def _organisations(documents: list) -> Iterator[dict]:
    for d in documents:
        if isinstance(d, list):
            yield from _organisations(d)
        elif isinstance(d, dict):
            if any(isinstance(k, str) and k.rpartition("/")[2] in ORGANISATIONS for k in listed(d.get("@type"))):
                yield d
            yield from _organisations([d[k] for k in ORG_MORE if k in d])


def said(page: str | None, url: str | None, source: str | None) -> list[tuple]:
    """All statements of a page, in page order within a topic. Plain tuples: a page may have very many."""
    dom, out = Dom(page, None), []
    foreign = dom.foreign()

    def say(topic, subject, predicate="", value="", link=None, at=None, edge=False, image=""):
        row = {"topic": topic, "subject": subject, "predicate": predicate, "object": value, "key": L.name_key(value), "image": image, "foreign": at is not None and foreign[at], "edge": edge}
        if link is not None:
            row["absolute"] = urljoin(url or "", link)
            row |= {"company": L.board_company(link, source, url or ""), "person": L.company_of(link, "in"), "site": L.own_site(link, url or ""), "number": L.company_number(link)}
            row["host"] = L.site_host(row["site"])
        out.append(tuple([row.get(n, "") for n in STATEMENT.names]))

    say("asked", 0, link=url or "")
    for n in dom.below():
        tag, attrs = dom.tag[n], dom.attrs[n]
        if tag == "link" and "canonical" in attrs.get("rel", "").split():
            say("canonical", n, link=attrs.get("href", ""))
        elif tag == "h1":
            say("heading", n, tag, dom.text(n), at=n)
        elif tag == "a":
            edge = any(dom.tag[a] in ("header", "footer") or "social" in dom.attrs[a].get("class", "").lower() for a in dom.above(n))
            say("anchor", n, " ".join(attrs.get(k, "") for k in MARKS).lower(), attrs.get("aria-label") or dom.text(n), attrs.get("href", ""), n, edge)
        elif tag == "section":
            say("section", n, attrs.get("data-test-id", ""), dom.first_text(n, tags=("h2",)), at=n)
            for link, title, subtitle, image in _cards(dom, n):
                say("card", n, subtitle, title, link, image=image)
    for n, label, text, links in _terms(dom):
        for link in links or [None]:
            say("term", n, label, text, link, n)
    for i, org in enumerate(_organisations(dom.json_ld())):
        for predicate in ORG_NAMES:
            for value in listed(org.get(predicate)):
                if isinstance(value, str):
                    say("org", i, predicate, value)
        if org.get("address"):
            say("org", i, "address", json.dumps(org["address"], sort_keys=True))
        for value in [v for k in ORG_LINKS for v in listed(org.get(k))]:
            link = value.get("@id") if isinstance(value, dict) else value
            if isinstance(link, str):
                say("org", i, "link", link, link)
    return out


statements = rowwise(said, T.ArrayType(STATEMENT))


def about(topic: str, where=None, column: Column | str = "_said") -> Column:
    """The statements of a topic for which a condition holds."""
    return F.filter(column, lambda s: (s["topic"] == topic) & (F.lit(True) if where is None else where(s)))


def each(found: Column, name: str) -> Column:
    """What statements have in one field, each once and in order, without what is empty."""
    return F.array_distinct(F.filter(F.transform(found, lambda s: s[name]), lambda x: x.isNotNull() & (x != "")))


def only(values: Column) -> Column:
    """The one value there is, or null."""
    return F.when(F.size(values) == 1, values[0])
