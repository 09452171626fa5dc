"""What a review of round 3 found, one small case each."""

import hashlib
import json
import random
from urllib.parse import urljoin, urlsplit

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions.board_links import link_parts
from gleanery.functions.dom import Dom
from gleanery.llm import media, webp
from gleanery.operators import boards, entities
from gleanery.plans import landed_queries
from gleanery.sources import tables
from gleanery.streaming import archive, walks


def test_text_keeps_references_that_are_cut_off(spark):
    """as in the SQL, a reference counts where a semicolon ends it."""
    df = spark.createDataFrame([("<p>a &amp; b&nbsp;c &#39;d&#39; &unknown; e&amp</p>",)], "html string")
    assert df.select(H.page_text("html")).first()[0] == "a & b c 'd' &unknown; e&amp"


def test_titles_keep_references_that_are_cut_off(spark):
    """the same for titles and headings."""
    df = spark.createDataFrame([("<title>x&lt;y &copy; z&amp</title><h1>one &amp; two&amp</h1>",)], "html string")
    r = df.select(H.title("html").alias("t"), H.h1s("html").alias("h")).first()
    assert (r.t, r.h) == ("x<y © z&amp", ["one & two&amp"])


def test_company_pages_of_any_size(spark):
    """a page beyond the bound of a tree keeps its people; each person once, in the order of the page."""
    card = lambda i: f'<li><a href="/in/p-{i}"></a><h3>Ann {i}</h3><h4>x</h4></li>'
    page = f'<link rel="canonical" href="https://www.linkedin.com/company/c/">{"<br>" * 61_000}<section data-test-id="employees-at">{card(2)}{card(1)}{card(2)}</section>'
    r = boards.company_pages(spark.createDataFrame([(page, "https://www.linkedin.com/company/c/")], "html string, company string")).first()
    assert r.status == "found" and [c.name for c in r.contacts] == ["Ann 2", "Ann 1"]


def test_orders_are_dealt_over_tasks(spark, tmp_path):
    """one small file of orders isn't one task of many pages."""
    spark.range(100).selectExpr("id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus", "1.0D as o_totalprice", "timestamp'1996-01-01' as o_orderdate", "'2-HIGH' as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = landed_queries.second_board_details(spark, str(tmp_path)).select("job_id", "detail_status", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in found}) == 4 and {r.detail_status for r in found} == {"ok"} and len({r.job_id for r in found}) == 100


def test_streamed_posts_share_groups(spark, tmp_path):
    """Python runs once a group of posts; with one group two batches of two archives still give each post its changes."""
    body = lambda likes: json.dumps([{"rest_id": str(i), "legacy": {"full_text": "x", "favorite_count": likes}} for i in range(3)])
    schema = "archive_id string, seq bigint, status int, body string"
    for seq, likes in ((0, 1), (1, 1), (2, 5)):
        spark.createDataFrame([(a, seq, 200, body(likes)) for a in "ab"], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = archive.streamed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "append", groups=1)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").select("archive_id", "id", "change", "seq", "favorite_count").collect()
    assert sorted(map(tuple, found)) == sorted((a, str(i), *x) for a in "ab" for i in range(3) for x in (("added", 0, 1), ("updated", 2, 5)))


def test_many_changes_of_a_page_go_in_rows(spark, tmp_path):
    """F8: no row of a walk holds more changes than a bound, and all of them are there."""
    posts = [{"rest_id": str(i), "legacy": {"full_text": "x", "favorite_count": i}} for i in range(2 * walks.PART + 5)]
    spark.createDataFrame([("a", 0, 200, json.dumps({"p": posts, "c": {"cursorType": "Bottom", "value": "n"}})), ("a", 1, 500, "{}")], "archive_id string, seq bigint, status int, body string").write.parquet(f"{tmp_path}/in")
    stream = walks.walked(spark.readStream.schema("archive_id string, seq bigint, status int, body string").parquet(f"{tmp_path}/in"), timers=False)
    with walks.small_batches(spark):
        run = stream.writeStream.format("memory").queryName("walk_rows").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.sql("select * from walk_rows")
    assert sorted(len(r.changes) for r in found.collect()) == [0, 5, walks.PART, walks.PART]
    assert found.agg(F.sum("added")).first()[0] == found.selectExpr("inline(changes)").select("id").distinct().count() == 2 * walks.PART + 5
    e = walks.ends(found).first()
    assert (e.stop, e.seq, e.pages, e.posts) == ("fail", 1, 1, 2 * walks.PART + 5)


def test_payloads_reach_python_in_small_batches(spark, tmp_path):
    """what Python parses at once is bounded by bytes, not by rows only."""
    spark.range(6).select("id", F.repeat(F.lit("x"), 1 << 20).alias("body")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    rows = F.arrow_udf(lambda a: pa.array([len(a)] * len(a), pa.int64()), "long")
    found = tables.table(spark, str(tmp_path), "t").select(rows("body").alias("n")).collect()
    assert len(found) == 6 and max(r.n for r in found) <= 3


def test_plain_pages_are_read_without_the_parser_and_the_same(monkeypatch):
    """F11, F12, F16: reading pages is the cost of these queries."""
    rng = random.Random(11)
    plain = ["<p>", "</p>", "<li>", "</li>", "<DIV>", "</div>", '<a href="/jobs/view/1" class="x y">', "</a>", "<br>", '<img src="a.png">', "text ", " > ", "\n", "</nothing>", '<b id="" data-testid="t" id="u">', "</b>"]
    odd = ["&amp;", "<script>", "</script>", "<!-- <p> -->", "<br/>", "<p class=x>", "< ", "<a href='x'>", "<title>", "</title>", "</p x>", "<p\nid=\"a\">", "<"]
    pages = ["".join(rng.choices(plain, k=rng.randint(0, 30))) for _ in range(400)]
    mixed = ["".join(rng.choices(plain + odd, k=rng.randint(0, 30))) for _ in range(400)]
    deep = "<div>" * 300 + "x"
    read = lambda page: (lambda d: (d.tag, d.attrs, d.up, d.kids, d.deep, d.end, d.too_large))(Dom(page))
    quick = [read(x) for x in [*pages, *mixed, deep]]
    with monkeypatch.context() as m:
        m.setattr(Dom, "_plain", lambda self, page: False)
        assert quick == [read(x) for x in [*pages, *mixed, deep]]
    monkeypatch.setattr(Dom, "feed", lambda self, page: pytest.fail("the parser was asked"))
    assert [read(x) for x in pages] == quick[: len(pages)]


def test_links_are_resolved_once_and_as_urls_are():
    """F11, F12, F16: plain links take a short way to the same result."""
    base = "https://www.linkedin.com"
    for value in ("/jobs/view/clerk-12", "/a/../b", "//evil.example/x", "/x?a=1&b=2", "/x?", "https://www.linkedin.com/company/co-1/", "https://u:p@linkedin.com/", "https://linkedin.com:444/x", "https://LinkedIn.com/x", "https://linkedin.com/x#y", "http://linkedin.com/", "x", " /x ", "/x;p=1", "https://[::1]/x", "https:///x"):
        for page in (base, base + "/jobs/", base + ":443/x", "https://www.indeed.com?q=/x", "http://plain.example/", ""):
            try:
                u = urlsplit(urljoin(page, value.strip()))
                want = u if u.scheme == "https" and not u.username and not u.password and u.port in (None, 443) and u.hostname else None
            except ValueError:
                want = None
            assert link_parts(value, page) == want, (value, page)
    assert link_parts(None, base) is None and link_parts("/a b", base) is None


def test_media_of_short_texts_are_read_together(spark, monkeypatch):
    """op11_media's cost: files of several batches of Arrow are decoded at once, up to a bound of bytes, and are what they were."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ,.") for _ in range(rng.randint(0, 3000))).encode() for _ in range(60)]
    files = media.files([media.payload(t) for t in texts])
    assert hashlib.sha256(b"".join(files)).hexdigest() == "f20e968d5379f57ad42e784f93b8dc812263419debd40b66fcec8431b251106e"
    batch = lambda i, j: pa.RecordBatch.from_arrays([pa.array(range(i, j), pa.int64()), pa.array(files[i:j], pa.binary())], names=["k", "media"])
    rows = spark.createDataFrame([], "k long, media binary")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: run)
    run, calls, decoded = media.features(rows, "k"), [], webp.decoded
    monkeypatch.setattr(webp, "decoded", lambda streams: calls.append(len(streams)) or decoded(streams))
    found = [r for b in run(batch(i, i + 10) for i in range(0, 60, 10)) for r in b.to_pylist()]
    assert len(calls) == 1 and [(r["k"], r["n_bytes"]) for r in found] == [(i, len(t)) for i, t in enumerate(texts)]
    assert [r["payload_sha256"] for r in found] == [hashlib.sha256(media.payload(t)).hexdigest() for t in texts]
    monkeypatch.setattr(media, "READ", 2 * max(map(len, files)))
    calls.clear()
    assert len([r for b in run(batch(i, i + 1) for i in range(60)) for r in b.to_pylist()]) == 60 and 1 < len(calls) < 60


def test_an_empty_slot_of_the_cache_counts_as_seen():
    """What a cache symbol names goes to the cache again: transparent black from an empty slot goes to slot 0."""
    put = lambda *pairs: sum(v << sum(n for _, n in pairs[:i]) for i, (v, _) in enumerate(pairs)).to_bytes(99, "little")
    one = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]
    red = next(r for r in range(256) if webp._slot(np.array([0xFF000B00 | r << 16], np.uint32), np.array([1]))[0] == 0)
    # Green: 11 (one bit), and slots 0 and 1 of the cache (two bits each); 11, 138 and 130 zeros before them.
    green = [(0, 1), (1, 4), (0, 3), (1, 3), (0, 3), (2, 3), (2, 3), (0, 1), (0, 1), (0, 7), (1, 2), (0, 1), (127, 7), (0, 1), (119, 7), (3, 2), (3, 2)]
    stream = put((0x2F, 8), (2, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1), *green, *one(red), *one(0), *one(255), *one(0), (0, 1), (3, 2), (1, 2))
    assert webp.decoded([stream])[0].pixels.tolist() == [0xFF000B00 | red << 16, 0, 0] and webp.decoded([]) == []


def test_rarest_runs_are_found_without_sorting_runs(spark):
    """neither the runs of names nor those that all names share are sorted in one task; all pairs are found."""
    rng = random.Random(15)
    names = ["FIRM " + "".join(rng.choices("AB", k=rng.randint(1, 9))) + end for end in ("", " OF AUSTIN") for _ in range(150)]
    short, long = (spark.createDataFrame([(x,) for x in sorted(set(some))], f"{c} string") for some, c in ((names[:200], "part"), (names[100:] + ["ABABA"], "whole")))
    found = entities.containing(short, long, "part", "whole")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and plan.count("ShuffledHashJoin") == 2
    want = {(p, w) for p in names[:200] for w in [*names[100:], "ABABA"] if p in w}
    assert len(want) > 300 and {tuple(r) for r in found.collect() if r.part in r.whole} == want
