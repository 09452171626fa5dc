"""Recursive looks into JSON: schema types, people, posts, cursors. Arrow UDFs that parse a document once."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

from gleanery.functions.arrow import rowwise

_SCRIPT = re.compile(r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)
#: Parts of JSON-LD that speak about somebody else.
OTHERS = ("review", "reviews", "author", "reviewrating", "aggregaterating", "rating")
PERSON_TYPES = ("Person", "Attorney")
COUNTS = ("favorite_count", "retweet_count", "reply_count", "quote_count", "bookmark_count")
PERSON = T.StructType([T.StructField(x, T.StringType()) for x in ("name", "title", "email", "phone", "url")])
POST = T.StructType([*[T.StructField(x, T.StringType()) for x in ("id", "text", "created_at")], *[T.StructField(x, T.LongType()) for x in (*COUNTS, "view_count")]])
PAGE = T.StructType([T.StructField("posts", T.ArrayType(POST)), T.StructField("cursor", T.StringType())])


def parsed(text):
    """The document, or None if it is none."""
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def nodes(root):
    """All objects of a document, outer ones first, in order. Without recursion, so depth is no matter."""
    todo = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def _types(html):
    found = {}
    for raw in _SCRIPT.findall(html or ""):
        for x in nodes(parsed(raw.strip())):
            t = x.get("@type")
            for one in t if isinstance(t, list) else [t]:
                if isinstance(one, str):
                    found[one] = None
    return list(found)


#: All @type values in a page's JSON-LD, in order, each once.
schema_types = rowwise(_types, T.ArrayType(T.StringType()))


def _text(x) -> str:
    return x.strip() if isinstance(x, str) else ""


def _people(html):
    found = []
    for raw in _SCRIPT.findall(html or ""):
        todo = [(parsed(raw.strip()), False)]
        while todo:
            x, other = todo.pop()
            if isinstance(x, list):
                todo.extend((v, other) for v in reversed(x))
            elif isinstance(x, dict):
                types = x.get("@type")
                types = types if isinstance(types, list) else [types]
                other = other or any(isinstance(t, str) and t.lower() in OTHERS for t in types)
                if not other and any(t in PERSON_TYPES for t in types) and _text(x.get("name")):
                    found.append({"name": _text(x["name"]), "title": _text(x.get("jobTitle")), "email": _text(x.get("email")).removeprefix("mailto:"), "phone": _text(x.get("telephone")), "url": _text(x.get("url"))})
                todo.extend((v, other or k.lower() in OTHERS) for k, v in reversed(list(x.items())))
    return found


#: People in a page's JSON-LD, but for those under reviews, ratings and authors.
schema_people = rowwise(_people, T.ArrayType(PERSON))


def _count(x):
    try:
        return int(float(x)) if x not in (None, "") else 0
    except (TypeError, ValueError, OverflowError):
        return 0


def _dict(x):
    return x if isinstance(x, dict) else {}


def post_of(x: dict):
    """The post that an object is, or None: an id and a text, the long form first."""
    legacy = _dict(x.get("legacy"))
    long = _dict(_dict(_dict(x.get("note_tweet")).get("note_tweet_results")).get("result")).get("text")
    text = str(long or legacy.get("full_text") or "")
    if not x.get("rest_id") or not text:
        return None
    views = _dict(x.get("views")).get("count")
    out = {"id": str(x["rest_id"]), "text": text, "created_at": str(legacy.get("created_at") or "")}
    out |= {k: _count(legacy.get(k)) for k in COUNTS}
    return out | {"view_count": None if views in (None, "") else _count(views)}


def page_of(body):
    """Posts of a payload, each once, and the cursor to go on from: the last Bottom one, else the last ShowMore."""
    posts, cursor, rank = {}, None, 0
    for x in nodes(parsed(body)):
        if post := post_of(x):
            posts.setdefault(post["id"], post)
        r = {"Bottom": 2, "ShowMore": 1}.get(x.get("cursorType") if isinstance(x.get("cursorType"), str) else "", 0)
        if r and r >= rank and isinstance(x.get("value"), str) and x["value"]:
            cursor, rank = x["value"], r
    return {"posts": list(posts.values()), "cursor": cursor}


#: Posts and cursor of a landed payload.
timeline = rowwise(page_of, PAGE)
