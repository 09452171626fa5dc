"""Walks over streamed pages: the same stops and posts as the batch forms, over restarts and from an initial state."""

import json
import os
import time

from gleanery.plans import fixtures
from gleanery.streaming import archive, walks

SCHEMA = "archive_id string, seq long, status int, headers map<string,string>, body string"


def land(folder, rows, start=0):
    folder.mkdir(exist_ok=True)
    for i, r in enumerate(rows):
        (folder / f"{start + i:03}.json").write_text(json.dumps(r.asDict()))
        os.utime(folder / f"{start + i:03}.json", (1_700_000_000 + start + i, 1_700_000_000 + start + i))  # files arrive in order


def run(spark, tmp_path, name, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    query = walks.walked(stream, timers=False, **options).writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / name))).outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def stops(df):
    return {r.archive_id: (r.stop, r.seq, r.pages, r.posts, r.cursor) for r in df.collect()}


def test_walk_over_a_restart_stops_as_the_batch_does(spark, tmp_path):
    pages = fixtures.payload_pages(spark)
    rows = pages.orderBy("archive_id", "seq").collect()
    land(tmp_path / "in", rows[:5])
    assert stops(walks.ends(run(spark, tmp_path, "out")))["a"][:2] == ("exhausted", 3)
    land(tmp_path / "in", rows[5:], 5)
    land(tmp_path / "in", rows[2:4], 50)  # the same pages again change nothing
    found = run(spark, tmp_path, "out")
    assert stops(walks.ends(found)) == stops(archive.stopped(pages))
    # Posts behind the stop aren't in the walk; all others are as the batch has them.
    held = {}
    for r in found.orderBy("seq").collect():
        for c in r.changes:
            held[r.archive_id, c.id] = (c.text, c.favorite_count, c.view_count)
    batch = {(r.archive_id, r.id): (r.text, r.favorite_count, r.view_count) for r in archive.archived(pages).collect()}
    assert batch.pop(("a", "9")) and held == batch
    assert [r.resume_at for r in found.where("archive_id = 'a' and seq = 2 and stop is null").collect()] == [1_700_000_000]


def test_walk_from_a_batch_archive_and_caps(spark, tmp_path):
    pages = fixtures.payload_pages(spark)
    land(tmp_path / "in", pages.where("seq > 1").orderBy("archive_id", "seq").collect())
    found = run(spark, tmp_path, "out", before=pages.where("seq <= 1 and archive_id in ('a', 'b')"), max_posts=3)
    got = stops(walks.ends(found))
    assert got["a"][:4] == ("max_posts", 2, 2, 3) and got["b"][:2] == ("rate_limited", 2)
    assert [(c.id, c.change) for r in found.where("archive_id = 'a' and seq = 2").collect() for c in r.changes] == [("1", "updated"), ("3", "added")]


def test_a_spent_window_opens_by_a_timer(spark, tmp_path):
    pages = fixtures.payload_pages(spark)
    land(tmp_path / "in", pages.where("archive_id = 'a' and seq in (0, 2)").orderBy("seq").collect())
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = walks.walked(stream).writeStream.format("memory").queryName("walk_timers").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 90
    found = []
    while time.time() < until and "window_open" not in found:
        found = [r.stop for r in spark.sql("select stop from walk_timers").collect()]
        time.sleep(1)
    query.stop()
    assert found.count("window_open") == 1 and found.count(None) == 2
