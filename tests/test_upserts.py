"""A table upserted by batches: replays and half-written batches change nothing."""

from gleanery.streaming import upserts


def test_replayed_and_broken_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "k string, v long, at long")
    schema = make([]).schema
    write = upserts.upserting(folder, schema, ["k"], ["at"], buckets=4)
    rows = lambda: {r.k: r.v for r in upserts.current(spark, folder, schema).collect()}
    assert rows() == {}
    write(make([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)]), 0)
    write(make([("a", 3, 3), ("c", 1, 3)]), 1)
    want = {"a": 3, "b": 1, "c": 1}
    assert rows() == want
    write(make([("a", 3, 3), ("c", 1, 3)]), 1)
    write(make([("a", 9, 9)]), 0)  # a batch that is done, whatever it brings
    assert rows() == want and upserts.manifest(spark, folder)[0] == 1
    # A batch that dies before its manifest: its files are there, its rows aren't.
    real, upserts._publish = upserts._publish, lambda *a: 1 / 0
    try:
        write(make([("b", 7, 7)]), 2)
    except ZeroDivisionError:
        pass
    finally:
        upserts._publish = real
    assert rows() == want
    write(make([("b", 7, 7)]), 2)
    write(make([]), 3)
    assert rows() == want | {"b": 7} and upserts.manifest(spark, folder)[0] == 3
