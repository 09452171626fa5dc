"""Main text of web pages by composite text density.

A page is parsed into a tree. Every node gets its composite density: characters per tag,
adjusted by how much of both belongs to links and by the link share of the whole body.
The node with the largest sum of child densities is the core of the article; the
smallest density on the path from it up to the body is the threshold that decides which
siblings along that path belong to the article as well.

What is never part of an article (scripts, styles, forms, menus, site headers and
footers, and elements whose class, id or role names a menu, advert, notice, sidebar or
comment list) is cut first. A name cuts only as a whole ("related-posts", not "has-sidebar"
or "share-price"), and never what holds the longest article, a main element or, where a page
has none of these, the core of the page as it is without cuts by name.

White space inside a block becomes one blank, blocks are joined by one blank, nothing
else is dropped. Defined results: a null or empty page, or one without text, gives the
empty text; tags and blocks that are never closed end with the page, an element that is cut
by its tag and never closed (a stray <svg> or <select>) holds nothing; repeated rows give
equal results. A page costs its length, whatever its markup.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may begin at a "<": a tag with its name, or something that isn't text (a comment, a declaration).
BEGIN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?])")
#: The rest of a tag, in which ">" may stand between quotes.
REST = re.compile(r"""([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
#: Tags whose quotes are never closed after which quotes mean nothing on a page any more.
BROKEN = 3
RAW = frozenset("script style textarea title noscript iframe template svg math select object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose start closes an open paragraph, and elements that close an open one of their own kind.
ENDS_P = BLOCK - frozenset("body br caption html option summary tbody td tfoot th thead title tr".split())
OWN_END = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "thead": ("table",)}
ALIKE = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead")}
CUT = frozenset("head script style noscript textarea iframe template svg math object select option form button input label fieldset nav footer aside menu dialog canvas audio video map".split())
#: Parts of class names and ids that name what is cut, and parts that only say where or how it stands. A name cuts if it has nothing else.
NOISE = re.compile(
    r"(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promos?|promotions?|comments?|commentlist|respond|disqus|reply|replies|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|"
    r"sidebars?|aside|widgets?|nav|navs|navbar|navigation|menus?|navmenu|breadcrumbs?|pagination|pager|footers?|copyright|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations?|trending|newsletters?|subscribe|subscription|signup|login|search|skip|tags|hidden)"
)
PLACE = frozenset("area bar block bottom box btn button buttons center col column container content count div element form global group head holder icon icons id inner item items js left level link links list main media message middle mobile module outer page panel post posts primary right row secondary section site slot small sticky sub text title to top unit wrap wrapper".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HEADER = re.compile(r"^header$|(?:^|\s)(?:site|global|main|top|page)[-_]?header(?=$|\s)", re.I)
CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | CUT}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(text)}


def names_noise(name: str) -> bool:
    """Whether a class name or id as a whole, by all of its parts, names what is cut: "related-posts" does, "has-sidebar" and "share-price" don't."""
    parts = [p.lower() for p in PARTS.findall(name)]
    found = [NOISE.fullmatch(p) is not None for p in parts]
    return any(found) and all(f or p in PLACE or p.isdigit() for f, p in zip(found, parts, strict=True))


def noise(tag: str, attrs: str, inside: bool, by_name: bool = True, holds: int = 0) -> bool:
    """Whether an element is cut. inside: it stands in an article, whose own header holds its headline. holds: see Tree.holders()."""
    if tag in CUT or tag == "header" and not inside:
        return True
    # An article inside another may be cut as well: comments of readers are marked up so.
    if not attrs or tag in ("html", "body", "main") or tag == "article" and not inside:
        return False
    found = attributes(attrs)
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if not by_name or holds == 2:
        return False
    if not inside and any(HEADER.search(found.get(x, "")) for x in ("class", "id")):
        return True
    if holds:
        return False
    return any(names_noise(name) for x in ("class", "id") for name in found.get(x, "").split())


class Tree:
    """Nodes in page order as parallel lists; texts hang on their nodes."""

    def __init__(self, html: str, by_name: bool = True, holds: dict[int, int] | None = None):
        self.tag, self.up, self.cut, self.by_name, self.holds = ["#page"], [-1], [False], by_name, holds or {}
        #: What follows in page order: (node, text), text None where a block begins or ends.
        self.flow: list[tuple[int, str | None]] = []
        self.read(html)

    def read(self, html: str) -> None:
        """One pass from left to right. Open elements lie on a stack, and each name knows where on it its own lie, so no tag costs a walk."""
        tag, up, flow, cut = self.tag, self.up, self.flow, self.cut
        stack, lies, blocks = [0], defaultdict(list), []  # nodes; depths of the open ones by name, and of blocks
        place, broken, last, ends = 0, 0, html.rfind(">"), {}

        def text(raw: str) -> None:
            if raw and not cut[stack[-1]]:
                flow.append((stack[-1], unescape(raw) if "&" in raw else raw))

        def close(depth: int) -> None:
            while len(stack) > depth:
                name = tag[stack.pop()]
                lies[name].pop()
                if name in BLOCK:
                    blocks.pop()

        def deepest(names) -> int:
            return max((lies[x][-1] for x in names if lies[x]), default=0)

        begun = 0
        while m := BEGIN.search(html, place):
            start, name = m.start(), m[2]
            if name is None:
                end = html.find("-->", m.end()) if m[0] == "<!--" else html.find(">", m.end())
                text(html[begun:start])
                place = begun = len(html) if end < 0 else end + (3 if m[0] == "<!--" else 1)
                continue
            if start > last:
                break
            rest = REST.match(html, m.end()) if broken < BROKEN else None
            if rest is None:
                broken += broken < BROKEN
                end = html.find(">", m.end())
                attrs, place = html[m.end() : end], end + 1
            else:
                attrs, place = rest[1], rest.end()
            text(html[begun:start])
            begun, name = place, name.lower()
            if m[1]:
                if name in BLOCK:
                    flow.append((stack[-1], None))
                # An inline end tag doesn't close blocks around it.
                if lies[name] and (name in BLOCK or not blocks or lies[name][-1] > blocks[-1]):
                    close(lies[name][-1])
                continue
            if name in BLOCK:
                flow.append((stack[-1], None))
            if name in ENDS_P and lies["p"] and blocks[-1] == lies["p"][-1]:
                close(blocks[-1])
            if name in OWN_END and (mine := deepest(ALIKE.get(name, (name,)))) > deepest(OWN_END[name]):
                close(mine)
            inside = bool(lies["article"] or lies["main"])
            node, at = len(tag), stack[-1]
            cuts = cut[at] or noise(name, attrs, inside, self.by_name, self.holds.get(node, 0))
            void = name in VOID or attrs.endswith("/")
            if not void and (name in RAW or name in CUT):
                # What is never closed holds nothing, but for scripts and styles, whose text is none.
                if name not in ends:
                    ends[name] = max((e.start() for e in CLOSE[name].finditer(html, place)), default=-1)
                if ends[name] < place:
                    void = name not in ("script", "style")
                    if not void:
                        place = begun = len(html)
                elif name in RAW:
                    place = begun = CLOSE[name].search(html, place).end()
            tag.append(name)
            up.append(at)
            cut.append(cuts or name in ("title", "textarea"))
            if not void and name not in RAW:
                lies[name].append(len(stack))
                if name in BLOCK:
                    blocks.append(len(stack))
                stack.append(node)
        text(html[begun:])

    def densities(self) -> tuple[list[float], list[float], int]:
        """Composite density of each node, sums of the densities of children and direct texts, and the body."""
        n = len(self.tag)
        own, chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.flow:
            if text:
                own[node] += len(" ".join(text.split()))
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.up[i]] or self.tag[i] == "a"
        for i in range(n - 1, -1, -1):
            chars[i] += own[i]
            link_chars[i] += own[i] if linked[i] else 0
            if i and not self.cut[i]:
                u = self.up[i]
                chars[u] += chars[i]
                link_chars[u] += link_chars[i]
                # Line breaks and bold words say nothing about the share of markup.
                block = self.tag[i] in BLOCK and self.tag[i] not in ("br", "hr") or self.tag[i] in ("a", "img")
                tags[u] += tags[i] + block
                link_tags[u] += link_tags[i] + (self.tag[i] == "a")
        share = link_chars[body] / max(1, chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if self.cut[i] or not chars[i]:
                continue
            c, lc, t, lt = chars[i], link_chars[i], max(1, tags[i]), link_tags[i]
            density[i] = c / t
            if share:  # without any link in the body the adjustment has nothing to adjust
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[i] *= math.log(max(1.0, c / max(1, lc) * (t / max(1, lt))), base)
            sums[i] += own[i] if not linked[i] else 0
            if i:
                sums[self.up[i]] += density[i]
        return density, sums, body

    def holders(self) -> dict[int, int]:
        """Of a tree without cuts by name: 2 for nodes around main elements and the longest article; else, without articles, 1 for those around the core."""
        size = [0] * len(self.tag)
        for node, text in self.flow:
            size[node] += len(text or "")
        for i in range(len(size) - 1, 0, -1):
            size[self.up[i]] += size[i]
        there = [i for i in range(len(size)) if not self.cut[i] and size[i]]
        # In a main element an article counts if half of the text is its own; else it may be a comment.
        main = [0] * len(size)
        for i in range(1, len(size)):
            main[i] = i if self.tag[i] == "main" else main[self.up[i]]
        articles = [i for i in there if self.tag[i] == "article" and (not main[i] or 2 * size[i] >= size[main[i]])]
        found = dict.fromkeys([i for i in there if self.tag[i] == "main"] + ([max(articles, key=size.__getitem__)] if articles else []), 2)
        if not any(self.tag[i] == "article" for i in there):
            _, sums, _ = self.densities()
            core = max(there, key=lambda i: (sums[i], -i), default=0)
            found[core] = found.get(core, 1)
        out = {}
        for i, how in found.items():
            while i > 0 and out.get(i, 0) < how:
                out[i] = how
                i = self.up[i]
        return out

    def chosen(self) -> list[bool]:
        """Which nodes belong to the main text."""
        density, sums, body = self.densities()
        n = len(self.tag)
        allowed = [i for i in range(n) if not self.cut[i] and density[i] > 0]
        if not allowed:
            return [False] * n
        core = max(allowed, key=lambda i: (sums[i], -i))
        path = [core]
        while path[-1] != body and path[-1] > 0:
            path.append(self.up[path[-1]])
        threshold = min(density[i] for i in path)
        on_path, take = set(path), [False] * n
        # An article or main element on the path holds all of the article.
        whole = next((i for i in reversed(path) if self.tag[i] == "article"), None) or next((i for i in reversed(path) if self.tag[i] == "main"), core)
        for i in range(n):
            if self.cut[i]:
                continue
            if i == whole or i and take[self.up[i]]:
                take[i] = True
            elif i not in on_path and i and self.up[i] in on_path and self.up[i] != 0 and self.tag[whole] not in ("article", "main"):
                take[i] = density[i] >= threshold and sums[i] > 0
        return take


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    for by_name in (True, False):  # names of a wrapper around everything say nothing: where all is cut, only tags count
        tree = Tree(html, by_name, Tree(html, False).holders() if by_name else None)
        take = tree.chosen()
        if found := " ".join("".join(" " if text is None else text for node, text in tree.flow if text is None or take[node]).split()):
            return found
    return ""


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars."""
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            found = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=schema.names)

    return pages.select(key, url, F.col(html).cast("string")).mapInArrow(run, schema)
