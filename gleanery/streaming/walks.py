"""A resumable archive that knows when to stop while it runs.

A stream of landed pages goes through one state per archive: a map of its posts, and a value
with where its walk stands. So caps, streaks without anything new, refusals and spent windows are
decided page by page, as ``archive.stopped`` decides them over all pages at once, and what a walk
has after its stop is left alone. A restart goes on from the checkpoint; a walk that
begins elsewhere gets the batch archive as its initial state.

State lies in the RocksDB store, a post an entry, so an archive may be larger than memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.functions.json import timeline
from gleanery.operators.merge import METRICS
from gleanery.streaming.archive import STREAK, archived, progress, rate_limit

#: Changes in one row at most, and rows that a stream started in small_batches() hands over at once.
PART, ROWS = 1000, 32
POST = "text string, created_at string, " + ", ".join(f"{m} bigint" for m in METRICS)
WALK = "seq bigint, pages bigint, posts bigint, idle int, refused int, stop string, resume_at bigint"
FIELDS = ["text", "created_at", *METRICS]
CHANGES = f"array<struct<id:string,{POST.replace(' string', ':string').replace(' bigint', ':bigint').replace(', ', ',')},change:string,pos:int>>"
OUT = f"archive_id string, seq bigint, stop string, pages bigint, posts bigint, added bigint, updated bigint, cursor string, resume_at bigint, changes {CHANGES}"


def merged(known: tuple | None, new: tuple) -> tuple:
    """A post after another sight of it: the first text and time that aren't empty, the newest numbers."""
    old = known or ("", "", *[None] * len(METRICS))
    return (old[0] or new[0] or "", old[1] or new[1] or "", *(o if n is None else n for o, n in zip(old[2:], new[2:], strict=True)))


def _row(told: dict, **more) -> dict:
    """A row in the order of OUT, by which rows are read."""
    return {name: (told | more)[name] for name in ("archive_id", "seq", "stop", "pages", "posts", "added", "updated", "cursor", "resume_at", "changes")}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside hand few rows at once to and from Python, as each may hold PART changes or a whole page; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Walk(StatefulProcessor):
    """One archive. Rows are pages: seq, status, posts, cursor, remaining, reset."""

    def __init__(self, max_posts: int = 0, max_pages: int = 0, retries: int = 1, timers: bool = True):
        self.max_posts, self.max_pages, self.retries, self.timers = max_posts, max_pages, retries, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known, self.walk = handle, handle.getMapState("posts", "id string", POST), handle.getValueState("walk", WALK)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, row: Row, timerValues) -> None:
        """A row of resumed(): a post, and where its archive's walk stands."""
        if row.id is not None:
            self.known.updateValue((row.id,), tuple(row[f] for f in FIELDS))
        self.walk.update((row.seq, row.pages, row.posts, row.idle, row.refused, row.stop, None))

    def reason(self, page: Row, walk: dict, moved: bool) -> str | None:
        """Why the walk ends at this page, if it does. The order of the rules is part of them."""
        if page.status == 429:
            return "rate_limited" if walk["refused"] > self.retries else None
        if page.status != 200:
            return "fail"
        if self.max_posts and walk["posts"] >= self.max_posts:
            return "max_posts"
        if self.max_pages and walk["pages"] >= self.max_pages:
            return "max_pages"
        if page.cursor is None or not (moved or page.found) or walk["idle"] >= STREAK:
            return "exhausted"
        return "rate_limited" if page.remaining is not None and page.remaining <= 0 and page.reset is None else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.walk.get() if self.walk.exists() else (-1, 0, 0, 0, 0, None, None)
        walk = dict(zip(("seq", "pages", "posts", "idle", "refused", "stop", "resume_at"), state, strict=True))
        for page in sorted(rows, key=lambda r: r.seq):
            if walk["stop"] is not None or page.seq <= walk["seq"]:
                continue  # behind the end, or landed twice
            changes = []
            walk["seq"] = page.seq
            if page.status == 200:
                for at, post in enumerate(page.found or []):
                    old = tuple(self.known.getValue((post["id"],))) if self.known.containsKey((post["id"],)) else None
                    now = merged(old, tuple(post[f] for f in FIELDS))
                    # New numbers are progress, a text that was missing isn't, but it is a change.
                    if now != old:
                        self.known.updateValue((post["id"],), now)
                        changes.append((post["id"], *now, "added" if old is None else "updated" if now[2:] != old[2:] else "filled", at))
                added, updated = (sum(c[-2] == kind for c in changes) for kind in ("added", "updated"))
                walk |= {"pages": walk["pages"] + 1, "posts": walk["posts"] + added, "idle": 0 if added or updated else walk["idle"] + 1, "refused": 0}
            else:
                added = updated = 0
                walk["refused"] += page.status == 429
            walk["stop"] = self.reason(page, walk, bool(added or updated))
            walk["resume_at"] = page.reset if walk["stop"] is None and page.remaining is not None and page.remaining <= 0 else None
            told = {"archive_id": key[0], "seq": page.seq, "pages": walk["pages"], "posts": walk["posts"], "cursor": page.cursor, "resume_at": walk["resume_at"]}
            # Very many changes go in rows of their own; the counts and the stop are on the page's last row.
            last = max(0, len(changes) - 1) // PART * PART
            for i in range(0, last, PART):
                yield Row(**_row(told, stop=None, added=0, updated=0, changes=changes[i : i + PART]))
            yield Row(**_row(told, stop=walk["stop"], added=added, updated=updated, changes=changes[last:]))
        self.walk.update(tuple(walk.values()))
        if self.timers:
            # A spent window holds the walk until it opens: one timer, for the last page's.
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if walk["resume_at"] is not None:
                self.handle.registerTimer(max(walk["resume_at"] * 1000, timerValues.getCurrentProcessingTimeInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The window is open: the walk may go on from its last page."""
        seq, pages, posts, idle, refused, stop, _ = self.walk.get()
        self.walk.update((seq, pages, posts, idle, refused, stop, None))
        yield Row(archive_id=key[0], seq=seq, stop="window_open", pages=pages, posts=posts, added=0, updated=0, cursor=None, resume_at=None, changes=[])


def _pages(pages: DataFrame) -> DataFrame:
    rate: Column = rate_limit(F.col("headers")) if "headers" in pages.columns else F.struct(*[F.lit(None).cast("bigint").alias(c) for c in ("remaining", "reset")])
    parsed = pages.select("archive_id", F.col("seq").cast("long").alias("seq"), F.col("status").cast("int").alias("status"), timeline("body").alias("t"), rate.alias("rate"))
    return parsed.select("archive_id", "seq", "status", F.col("t.posts").alias("found"), F.col("t.cursor").alias("cursor"), F.col("rate.remaining").cast("bigint").alias("remaining"), F.col("rate.reset").cast("bigint").alias("reset"))


def resumed(pages: DataFrame, retries: int = 1) -> DataFrame:
    """The initial state of walks that have these landed pages behind them: their posts, and where each one stands (not stopped)."""
    p = progress(pages)
    ok = F.col("status") == 200
    moves = F.count_if(ok & ((F.col("added") > 0) | (F.col("updated") > 0)))
    w = Window.partitionBy("archive_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"_moves": moves.over(w), "_oks": F.count_if(ok).over(w)})
    last = p.groupBy("archive_id").agg(F.max("_moves").alias("_m"), F.max("_oks").alias("_o"))
    j = p.join(last, "archive_id")
    idle = F.count_if(ok & (F.col("_moves") == F.col("_m")) & (F.col("added") == 0) & (F.col("updated") == 0)).cast("int")
    refused = F.count_if((F.col("status") == 429) & (F.col("_oks") == F.col("_o"))).cast("int")
    at = j.groupBy("archive_id").agg(F.max("seq").alias("seq"), F.count_if(ok).alias("pages"), F.sum("added").alias("posts"), idle.alias("idle"), refused.alias("refused"), F.lit(None).cast("string").alias("stop"))
    posts = archived(pages).select("archive_id", "id", *FIELDS)
    return at.join(posts, "archive_id", "left")


def walked(pages: DataFrame, max_posts: int = 0, max_pages: int = 0, retries: int = 1, before: DataFrame | None = None, timers: bool = True) -> DataFrame:
    """A row a page (more where it brings more than PART changes) as walks go over a stream of landed pages (archive_id, seq, status, headers, body): its changes, and, at its end, why it ends.

    before: pages that the walks have behind them. timers: whether walks wait for their windows; a query with timers
    runs on for them, so a run over what has landed (trigger availableNow) goes without. The session gets
    the RocksDB state store, which a map in state needs. Pages of a walk must come in order of seq, but within a batch they may
    lie as they like; what comes behind a later page is taken for one that landed twice.
    """
    spark: SparkSession = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    initial = resumed(before, retries).groupBy("archive_id") if before is not None else None
    return _pages(pages).groupBy("archive_id").transformWithState(Walk(max_posts, max_pages, retries, timers), OUT, "Update", "ProcessingTime" if timers else "None", initial)


def ends(walk: DataFrame) -> DataFrame:
    """Per archive of a walked() table how and where its walk ends; one that ran out of pages is exhausted."""
    real = walk.where("stop is null or stop <> 'window_open'")
    at = F.struct(F.col("stop").isNull().alias("open"), "seq", "stop", "pages", "posts", "cursor")
    # The row that stops, or else the last.
    found = real.groupBy("archive_id").agg(F.min(F.when(F.col("stop").isNotNull(), at)).alias("s"), F.max(at).alias("e"))
    return found.select("archive_id", F.coalesce("s", "e").alias("x")).select("archive_id", F.coalesce("x.stop", F.lit("exhausted")).alias("stop"), "x.seq", "x.pages", "x.posts", "x.cursor")
