"""What listing and detail pages of job boards show, as it stands: no rule about whose job it is applies here.

One reader serves both boards; they differ by the marks in BOARDS. operators.boards decides by
column rules over what is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin

from pyspark.sql import types as T

from gleanery.functions import board_links as L
from gleanery.functions.arrow import rowwise
from gleanery.functions.dom import Dom, description, of_type
from gleanery.functions.statements import listed


class Marks(NamedTuple):
    """Where a text stands: elements of these classes, test ids, ids or tags."""

    classes: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


class Board(NamedTuple):
    job: Callable
    company: Callable
    base: str
    outermost: bool
    card: Marks
    title: Marks
    place: Marks
    posted: Marks = Marks()
    pay: Marks = Marks()
    firm: Marks = Marks()
    top: Marks = Marks()
    employer: Marks = Marks()
    text: Marks = Marks()
    #: What the text stands in, if that matters.
    within: Marks | None = None
    closed: Marks = Marks()
    apply: Marks = Marks()
    more: dict[str, Marks] = {}


# Fixed values.
BOARDS = {
    "linkedin": Board(
        L.job_of, L.company_of, L.FIRST, True, Marks(("base-search-card",)), Marks(("base-search-card__title", "top-card-layout__title"), tags=("h3",)), Marks(("job-search-card__location", "topcard__flavor--bullet")),
        top=Marks(("top-card-layout", "topcard")), employer=Marks(("topcard__org-name-link",)), text=Marks(("show-more-less-html__markup",)), within=Marks(("description",)), closed=Marks(("closed-job__flavor--closed", "closed-job__flavor")),
        more={"salary_text": Marks(("salary", "compensation__salary", "salary__range")), "applicants": Marks(("num-applicants__caption", "num-applicants__figure", "topcard__flavor--metadata"))},
    ),
    "indeed": Board(
        L.second_job_of, L.second_company_of, L.SECOND, False, Marks(("job_seen_beacon",), ("job-card", "cmp-job-list-item", "job-list-item"), tags=("li",)), Marks(tags=("h2", "h3")), Marks(("companyLocation",), ("text-location", "job-location", "inlineHeader-companyLocation", "jobLocationText")),
        posted=Marks(("date",), ("myJobsStateDate",)), pay=Marks(("salary-snippet-container", "salary-snippet", "salaryOnly"), ("salary-snippet", "job-salary")), firm=Marks(("companyName",), ("company-name", "companyName")),
        employer=Marks(tests=("inlineHeader-companyName", "jobsearch-CompanyInfoContainer")), text=Marks(("jobsearch-jobDescriptionText",), ("jobDescriptionText",), ("jobDescriptionText",)), closed=Marks(("jobsearch-JobExpiredBanner",), ("job-expired-message", "jobsearch-JobExpiredBanner")),
        apply=Marks(tests=("apply-button", "applyButtonLink", "applyButtonLinkContainer"), ids=("applyButtonLink", "indeedApplyButton")),
        more={"name": Marks(("jobsearch-JobInfoHeader-title",), ("jobsearch-JobInfoHeader-title",)), "pay_text": Marks(tests=("salaryInfoAndJobType", "salary-snippet"), ids=("salaryInfoAndJobType", "salary-snippet")), "posted_text": Marks(tests=("job-age",), ids=("job-age",)), "benefits_text": Marks(tests=("benefits",), ids=("benefits",))},
    ),
}
CRITERION = Marks(("description__job-criteria-item",)), Marks(("description__job-criteria-subheader",), tags=("h3",)), Marks(("description__job-criteria-text",))
POSTING_IDS, POSTING_LINKS = ("url", "@id", "mainEntityOfPage"), ("sameAs", "url", "@id")
WALL_PATH = re.compile(r"https?://[^/]*/(?:[^?#]*/)?(?:auth|authwall|account|login|challenge|checkpoint|cdn-cgi)(?:[/?#]|$)")
WALL_TITLE = re.compile(r"just a moment|access denied|additional verification|verify (?:you are|your identity)|security check|sign in.*indeed|^(?:sign in|join) .*linkedin")

_S = T.StringType()
_struct = lambda **fields: T.StructType([T.StructField(k, t) for k, t in fields.items()])
EMPLOYER = _struct(company=_S, name=_S)
VACANCY = _struct(job_id=_S, url=_S, title=_S, place=_S, date=_S, posted=_S, pay=_S, firm=_S, firm_key=_S, employers=T.ArrayType(EMPLOYER), text=_S, structured=T.BooleanType())
LISTING_PAGE = _struct(walled=T.BooleanType(), company=_S, next_url=_S, vacancies=T.ArrayType(VACANCY))
TEXT = _struct(text=_S, html=_S)
POSTING = _struct(jobs=T.ArrayType(_S), employers=T.ArrayType(_S), employer_name=_S, fields=T.MapType(_S, _S), description=TEXT)
DETAIL_PAGE = _struct(
    walled=T.BooleanType(), named=T.ArrayType(_S), has_top=T.BooleanType(), top_job=_S, top_text=_S, employers=T.ArrayType(_S), employer_name=_S, employer_key=_S, title=_S, place=_S, description=TEXT, has_text=T.BooleanType(), closed=_S, more=T.MapType(_S, _S), criteria=T.MapType(_S, _S),
    apply=T.ArrayType(_S), postings=T.ArrayType(POSTING),
)


def is_wall(dom: Dom, url: str | None) -> bool:
    """Whether a page is a login or a check instead of what was asked for."""
    return WALL_PATH.match(url or "") is not None or WALL_TITLE.search(dom.first_text(tags=("title",)).lower()) is not None


def at(dom: Dom, n: int, marks: Marks) -> bool:
    attrs = dom.attrs[n]
    return dom.tag[n] in marks.tags or bool(attrs) and (attrs.get("data-testid") in marks.tests or attrs.get("id") in marks.ids or "class" in attrs and not set(marks.classes).isdisjoint(attrs["class"].split()))


def nodes_at(dom: Dom, marks: Marks, under: int = 0) -> list[int]:
    return dom.marked(under, *marks)


def text_at(dom: Dom, marks: Marks, under: int = 0, fits: str = "") -> str:
    """The first text that isn't empty at these marks, and has what fits finds."""
    for n in dom.marked(under, *marks):
        if (t := dom.text(n)) and (not fits or re.search(fits, t, re.I)):
            return t
    return ""


def own_links(dom: Dom, board: Board, url: str) -> list[str]:
    """Addresses by which a page names itself."""
    out = []
    for n, attrs in enumerate(dom.attrs):
        if attrs:
            out += [attrs.get("href", "")] if dom.tag[n] == "link" and "canonical" in attrs.get("rel", "").split() else [attrs.get("content", "")] if attrs.get("property") == "og:url" else []
    return out


def postings(dom: Dom, board: Board, url: str) -> Iterator[tuple[dict, list[str], list[str], str]]:
    """JobPosting objects with the jobs and the employers that their links name, and the employer's name."""
    for x in of_type(dom.json_ld(), "JobPosting"):
        org = x.get("hiringOrganization") if isinstance(x.get("hiringOrganization"), dict) else {}
        jobs = {board.job(x[k], url)[0] for k in POSTING_IDS if isinstance(x.get(k), str)} - {""}
        employers = {board.company(v, base=url) for k in POSTING_LINKS for v in listed(org.get(k))} - {""}
        yield x, sorted(jobs), sorted(employers), str(org.get("name") or "")


def listing(page: str | None, url: str | None, source: str) -> dict:
    """What a listing page shows: its cards in order, then its structured postings."""
    dom, board, url = Dom(page, None), BOARDS[source], url or BOARDS[source].base
    foreign, shown, met = dom.foreign(), [], set()
    is_card = lambda n, job: at(dom, n, board.card) or dom.attrs[n].get("data-jk") == job or dom.attrs[n].get("data-entity-urn", "").startswith("urn:li:jobPosting:")
    links = [(n, *board.job(dom.attrs[n].get("href", ""), url)) for n in dom.marked(tags=("a",))]
    cards = any(is_card(a, job) for n, job, _ in links if job for a in dom.above(n))
    for n, job, link in links:
        around = [a for a in dom.above(n) if a > 0 and (is_card(a, job) if cards else dom.tag[a] == "li")] if job else []
        card = around[-1 if board.outermost else 0] if around else n
        # A card within a foreign part is foreign as a whole; a foreign link in a card of the page isn't the card's job.
        if not job or (card in met if board.outermost else foreign[n] and not foreign[card]) or board.outermost and not around:
            continue
        met.add(card)
        times = dom.marked(card, tags=("time",))
        employers = [(c, dom.text(a)) for a in dom.marked(card, tags=("a",)) if not board.job(dom.attrs[a].get("href", ""), url)[0] and (c := board.company(dom.attrs[a].get("href", ""), base=url))]
        firm = text_at(dom, board.firm, card)
        title = text_at(dom, board.title, card) or ("" if board.outermost else dom.attrs[n].get("title") or dom.text(n))
        shown.append((job, link, title, text_at(dom, board.place, card), dom.attrs[times[0]].get("datetime", "") if times else "", text_at(dom, board.posted, card) or (dom.text(times[0]) if times else ""), text_at(dom, board.pay, card), firm, L.name_key(firm), employers, dom.text(card), False))
    for x, jobs, employers, name in postings(dom, board, url):
        if len(jobs) == 1:
            link = next(v for k in POSTING_IDS if isinstance(x.get(k), str) and (v := board.job(x[k], url)[1]))
            shown.append((jobs[0], link, str(x.get("title") or x.get("name") or ""), "", str(x.get("datePosted") or ""), "", "", name, L.name_key(name), [(c, "") for c in employers], "", True))
    onward = (urljoin(url, dom.attrs[n].get("href", "")) for n, *_ in links if "next" in dom.attrs[n].get("rel", "").split() or re.search(r"\bnext\b", dom.attrs[n].get("aria-label", "") + " " + dom.text(n), re.I))
    onward, here = L.link_parts(next(onward, ""), url), L.link_parts(url, url)
    own = [c for n in dom.marked(tags=("link",)) if "canonical" in dom.attrs[n].get("rel", "").split() and (c := board.company(dom.attrs[n].get("href", ""), base=url))]
    return {"walled": is_wall(dom, url), "company": "".join(own[:1]), "next_url": onward.geturl() if onward and here and onward.netloc == here.netloc else "", "vacancies": [dict(zip(VACANCY.names, [*v[:9], [{"company": c, "name": t} for c, t in v[9]], *v[10:]], strict=True)) for v in shown]}


def detail(page: str | None, url: str | None, source: str) -> dict:
    """What a detail page shows of a job."""
    dom, board, url = Dom(page, None), BOARDS[source], url or BOARDS[source].base
    top = next(iter(nodes_at(dom, board.top)), None)
    scope = top or 0
    boxes = nodes_at(dom, board.employer, scope)
    shown = {board.company(dom.attrs[a].get("href", ""), base=url) for box in boxes for a in dom.marked(box, tags=("a",))} - {""}
    inside = lambda n: board.within is None or any(at(dom, a, board.within) or dom.attrs[a].get("data-section") == "description" for a in dom.above(n))
    text = next((n for n in nodes_at(dom, board.text) if inside(n)), None)
    found = []
    for x, jobs, employers, name in postings(dom, board, url):
        raw = x["description"].get("text") if isinstance(x.get("description"), dict) else x.get("description")
        fields = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in x.items() if k not in ("description", "hiringOrganization") and v not in (None, "", [], {})}
        found.append({"jobs": jobs, "employers": employers, "employer_name": name, "fields": list(fields.items()), "description": dict(zip(("text", "html"), description(Dom(raw)) if isinstance(raw, str) else ("", ""), strict=True))})
    items = [(text_at(dom, CRITERION[1], n).lower().rstrip(":"), text_at(dom, CRITERION[2], n)) for n in nodes_at(dom, CRITERION[0])]
    buttons = [n for n in nodes_at(dom, board.apply) if dom.tag[n] == "a"]
    foreign = dom.foreign() if buttons else []
    applies = [h for n in buttons if not foreign[n] and re.match(r"https?://[^/\s@]+\.[a-z]", h := urljoin(url, dom.attrs[n].get("href", "")))]
    name = dom.text(boxes[0]) if boxes else ""
    urn = dom.attrs[top].get("data-entity-urn", "") if top else ""
    return {
        "walled": is_wall(dom, ""), "named": sorted({board.job(v, url)[0] for v in own_links(dom, board, url)} - {""}), "has_top": top is not None, "top_job": urn.rpartition(":")[2] if urn.startswith("urn:li:jobPosting:") else "", "top_text": dom.text(top) if top else "",
        "employers": sorted(shown), "employer_name": name, "employer_key": L.name_key(name), "title": text_at(dom, board.title, scope), "place": text_at(dom, board.place, scope), "description": dict(zip(("text", "html"), description(dom, text) if text is not None else ("", ""), strict=True)), "has_text": text is not None,
        "closed": text_at(dom, board.closed), "more": [(k, text_at(dom, m, scope if k == "applicants" else 0, "applicant" if k == "applicants" else "")) for k, m in board.more.items()], "criteria": list({k: v for k, v in items if v}.items()),
        "apply": [h for h in applies if not board.job(h)[0] and not board.company(h)], "postings": found,
    }


listing_page, detail_page = rowwise(listing, LISTING_PAGE), rowwise(detail, DETAIL_PAGE)
