"""A small document tree and what is read from it, for facts that need ancestry.

dom_nodes is a table function that turns a page into rows; selectors then are filters. Functions of
whole pages (description texts, board cards) use the same tree inside Arrow UDFs.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.json import nodes as json_nodes
from gleanery.functions.json import parsed

# Bounds of a tree, and what is no part of a page's own facts.
MOST_NODES, MOST_DEPTH = 60_000, 160
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN_WORDS = ("recommend", "related", "similar", "affiliate", "partner", "client", "testimonial", "employees-at", "job-description", "jobdescription")
FOREIGN_MARK = re.compile("|".join(FOREIGN_WORDS))
FOREIGN_HEADINGS = re.compile(r"^(?:our |trusted )?(?:clients|partners|affiliates)|people also|similar companies")
MARKS = ("id", "class", "data-testid", "data-test-id", "aria-label")
BLOCKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 ul ol li blockquote pre tr".split())
SAFE = BLOCKS | frozenset("strong b em i u br a code table thead tbody td th hr".split())
DROPPED = frozenset("script style iframe svg math form button input noscript template object embed".split())


#: A tag as most are written, with the text between tags left over; its attributes; and elements whose content is no markup.
PLAIN_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)((?: [a-z][a-z0-9_-]*=\"[^\"<>&]*\")*)>")
PLAIN_ATTR = re.compile(r" ([^=]+)=\"([^\"]*)\"")
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


class Dom(HTMLParser):
    """Nodes in page order: tag, attrs, up (parent), kids (nodes and texts). Node 0 is the page. too_large: it broke a bound. most: nodes at most, None for all.

    What is under a node follows it without a gap: node is the first, end[node] the first behind.
    """

    def __init__(self, page: str | None, most: int | None = MOST_NODES):
        self.most = most
        if not self._plain(page or ""):
            super().__init__(convert_charrefs=True)
            self._begin()
            self.feed(page or "")
            self.close()
        self.end = list(range(1, len(self.tag) + 1))
        for n in range(len(self.tag) - 1, 0, -1):
            self.end[self.up[n]] = max(self.end[self.up[n]], self.end[n])
        self._marked: tuple[dict[str, list[int]], ...] | None = None

    def _begin(self):
        self.tag, self.attrs, self.up, self.kids, self.deep = ["#page"], [{}], [-1], [[]], [0]
        self.at, self.too_large = 0, False

    def _plain(self, page: str) -> bool:
        """Read a page all of whose markup is plain tags, which the parser would read the same but slower; False where there is anything else."""
        if "&" in page or "\0" in page:
            return False
        parts = PLAIN_TAG.split(page)
        if page.count("<") != len(parts) // 3 or self.most is not None and len(parts) // 3 >= self.most:
            return False
        self._begin()
        tags, attrs, up, kids, deep, now = self.tag, self.attrs, self.up, self.kids, self.deep, 0
        if parts[0]:
            kids[0].append(parts[0])
        for k in range(1, len(parts), 3):
            name, more, text = parts[k].lower(), parts[k + 1], parts[k + 2]
            if name[0] == "/":
                if more:
                    return False
                node, name = now, name[1:]
                while node > 0 and tags[node] != name:
                    node = up[node]
                if node > 0:
                    now = up[node]
            else:
                if name in RAW or deep[now] >= MOST_DEPTH:
                    return False
                node = len(tags)
                kids[now].append(node)
                tags.append(name)
                attrs.append(dict(PLAIN_ATTR.findall(more)) if more else {})
                up.append(now)
                kids.append([])
                deep.append(deep[now] + 1)
                if name not in VOID:
                    now = node
            if text:
                kids[now].append(text)
        self.at = now
        return True

    def updatepos(self, i, j):
        """Lines and columns of tags aren't needed."""
        return j

    def handle_starttag(self, tag, attrs):
        if self.too_large or self.most is not None and len(self.tag) >= self.most or self.deep[self.at] >= MOST_DEPTH:
            self.too_large = True
            return
        node = len(self.tag)
        self.kids[self.at].append(node)
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.up.append(self.at)
        self.kids.append([])
        self.deep.append(self.deep[self.at] + 1)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        before = self.at
        self.handle_starttag(tag, attrs)
        self.at = before

    def handle_endtag(self, tag):
        node = self.at
        while node > 0 and self.tag[node] != tag:
            node = self.up[node]
        if node > 0:
            self.at = self.up[node]

    def handle_data(self, data):
        self.kids[self.at].append(data)

    def below(self, node: int = 0) -> range:
        """The node and all under it, in page order."""
        return range(node, self.end[node])

    def marked(self, node: int = 0, classes=(), tests=(), ids=(), tags=()) -> list[int]:
        """Nodes under a node of any of these classes, test ids, ids or tags, in page order. Where each stands is noted once a page."""
        if self._marked is None:
            self._marked = by_class, by_test, by_id, by_tag = {}, {}, {}, {}
            for n, (tag, attrs) in enumerate(zip(self.tag, self.attrs, strict=True)):
                by_tag.setdefault(tag, []).append(n)
                if not attrs:
                    continue
                for name, by in (("data-testid", by_test), ("id", by_id)):
                    if name in attrs:
                        by.setdefault(attrs[name], []).append(n)
                if "class" in attrs:
                    for c in set(attrs["class"].split()):
                        by_class.setdefault(c, []).append(n)
        found = []
        for names, by in zip((classes, tests, ids, tags), self._marked, strict=True):
            if names and by:
                found += [by[x] for x in names if x in by]
        if not found:
            return []
        every = found[0] if len(found) == 1 else sorted({n for at in found for n in at})
        if node == 0:
            return every[:]
        return every[bisect_left(every, node) : bisect_left(every, self.end[node])]

    def above(self, node: int):
        while node >= 0:
            yield node
            node = self.up[node]

    def text(self, node: int = 0) -> str:
        """All text under a node, without scripts and styles."""
        if self.end[node] == node + 1 and self.tag[node] not in ("script", "style"):
            # Nothing but texts.
            return " ".join(" ".join(self.kids[node]).split())
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif self.tag[n] not in ("script", "style"):
                todo += reversed(self.kids[n])
        return " ".join(" ".join(out).split())

    def has_class(self, node: int, name: str) -> bool:
        return name in self.attrs[node].get("class", "").split()

    def find(self, node: int = 0, classes=(), tags=(), tests=()):
        """Nodes under a node of any of these classes, tags or test ids."""
        return self.marked(node, classes, tests, (), tags)

    def first_text(self, node: int = 0, classes=(), tags=(), tests=()) -> str:
        return next((t for n in self.find(node, classes, tags, tests) if (t := self.text(n))), "")

    def foreign(self) -> list[bool]:
        """Which nodes speak of somebody else: recommendations, clients, testimonials and the like. Found once, top down."""
        out = []
        for n in range(len(self.tag)):
            attrs = self.attrs[n]
            own = self.tag[n] in ("aside", "article") or bool(attrs) and FOREIGN_MARK.search(" ".join([attrs[k] for k in MARKS if k in attrs]).lower()) is not None
            if self.tag[n] == "section" and not own:
                head = next((self.text(k).lower() for k in self.kids[n][:6] if isinstance(k, int) and self.tag[k] in ("h2", "h3")), "")
                own = bool(FOREIGN_HEADINGS.search(head))
            out.append(own or n > 0 and out[self.up[n]])
        return out

    def json_ld(self) -> list:
        """Documents of JSON-LD scripts."""
        found = [parsed("".join(k for k in self.kids[n] if isinstance(k, str))) for n in self.marked(tags=("script",)) if self.attrs[n].get("type", "").lower() == "application/ld+json"]
        return [x for x in found if x is not None]


def of_type(documents: list, *types: str) -> list[dict]:
    """Objects of these types anywhere in documents."""
    out = []
    for d in documents:
        for x in json_nodes(d):
            t = x.get("@type")
            if any(isinstance(one, str) and one in types for one in (t if isinstance(t, list) else [t])):
                out.append(x)
    return out


NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("excluded", T.BooleanType()), T.StructField("status", T.StringType()),
    ]
)


@F.udtf(returnType=NODE)
class DomNodes:
    """One row for each element of a page. text is that of the element itself, not of those inside. A page that breaks a bound has one row that says so."""

    def eval(self, page: str):
        if page is None:
            return
        dom = Dom(page)
        if dom.too_large:
            yield 0, None, "#page", {}, None, 0, False, "too_large"
            return
        foreign = dom.foreign()
        for n in range(len(dom.tag)):
            own = " ".join("".join(k if isinstance(k, str) else " " for k in dom.kids[n]).split())
            yield n, None if n == 0 else dom.up[n], dom.tag[n], dom.attrs[n], own, dom.deep[n], foreign[n], "ok"


SAFE_LINK, GAPS = re.compile(r"https?://[^/\s@]+\.[a-z]", re.I), re.compile(r"\n{3,}")


def description(dom: Dom, node: int = 0) -> tuple[str, str]:
    """Text with line breaks and list marks, and the same as HTML of safe tags only."""
    text, html = [], []
    # Nodes and texts to come; behind a node's own its end, as ~node.
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            text.append(n)
            html.append(entities.escape(n, quote=False))
            continue
        ends = n < 0
        tag = dom.tag[~n if ends else n]
        if tag in DROPPED:
            continue
        if ends:
            if tag in SAFE and tag not in ("br", "hr"):
                html.append(f"</{tag}>")
            text.append("\n" if tag in BLOCKS else "\t" if tag in ("td", "th") else "")
            continue
        if tag in BLOCKS or tag in ("br", "hr"):
            text.append("\n- " if tag == "li" else "\n")
        if tag in SAFE:
            link = dom.attrs[n].get("href", "") if tag == "a" else ""
            safe = link and SAFE_LINK.match(link)
            html.append(f'<{tag} href="{entities.escape(link)}" rel="nofollow noopener noreferrer">' if safe else f"<{tag}>")
        todo.append(~n)
        todo += reversed(dom.kids[n])
    lines = [" ".join(x.split()) for x in "".join(text).splitlines()]
    return GAPS.sub("\n\n", "\n".join(lines)).strip(), "".join(html).strip()


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("html", T.StringType())]))
def safe_description(fragment: pd.Series) -> pd.DataFrame:
    """Plain text and safe HTML of a fragment."""
    return pd.DataFrame([description(Dom(x)) for x in fragment], columns=["text", "html"], index=fragment.index)
