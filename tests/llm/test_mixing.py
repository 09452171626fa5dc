import re
from collections import defaultdict

import numpy as np

from gleanery.llm import mixing


def brute_seats(votes, n):
    out = [0] * len(votes)
    for _ in range(n):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_seats_are_the_highest_quotients():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 100):
        votes = rng.integers(1, 1000, 12).astype(float)
        assert mixing.seats(votes, n).tolist() == brute_seats(votes.tolist(), n)
    assert mixing.seats(np.array([5.0, 5.0, 5.0]), 4).tolist() == [2, 1, 1]  # ties to the earlier
    assert mixing.seats(np.array([9.0, 0.0]), 5, np.array([3, 3])).tolist() == [3, 0]


def test_targets():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []
    t = mixing.targets([1, 50, 5, 1000], [5, 2, 1, 5])
    assert abs(sum(t) - 1056) < 1e-6 and all(x <= 3 * s for x, s in zip(t, [1, 50, 5, 1000], strict=True))


def test_mix_against_brute_force(spark, documents):
    got = mixing.mix(documents).collect()
    assert len(got) == documents.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r.size == size(r.text) and 0 <= r.taken <= 3 * r.size and r.kept == "clash" for r in got)
    total = defaultdict(int)
    for r in got:
        total[r.source] += r.size
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in names:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(documents.repartition(7)).collect()
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in rows)
    assert key(got) == key(again)


def test_sections_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SECTIONS", 3)
    monkeypatch.setattr(mixing, "SHARD_DOCS", 20)
    # Half of the rows have no id; they lie in many shards as others do.
    df = spark.range(4000).selectExpr("if(id % 2 = 0, id, null) as doc_id", "concat(id, repeat(' w', cast(id % 50 as int))) as text", "case when id % 5 < 3 then 'a' when id % 5 = 3 then null else concat('s', id % 40) end as source")
    rows = mixing.mix(df).selectExpr("source", "size", "taken", "target", "source_size").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert len(rows) == 4000 and all(0 <= r.taken <= 3 * r.size for r in rows)
    want = mixing.targets([by[s][0].source_size for s in sorted(by, key=lambda s: (s is None, s or ""))], [(5, 2, 1)[i % 3] for i in range(len(by))])
    for s, t in zip(sorted(by, key=lambda s: (s is None, s or "")), want, strict=True):
        assert abs(by[s][0].target - t) < 1e-6 and abs(sum(r.taken for r in by[s]) - t) <= max(5, 0.01 * t), (s, t)


def test_quotas_of_many_sources():
    import time

    began = time.time()
    out = mixing.quotas([(f"s{i:05}", 0, 100 + i % 7) for i in range(20_000)])
    assert len(out) == 20_000 and time.time() - began < 20


def test_many_shards_and_empty(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "if(id % 3 = 0, 'a', 'b') as source")
    got = mixing.mix(df).selectExpr("source", "taken", "target").collect()
    for s in "ab":
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.01 * rows[0].target
    assert mixing.mix(df.where("false")).count() == 0
    zero = mixing.mix(df.selectExpr("doc_id", "cast(null as string) as text", "source")).selectExpr("max(taken)", "max(target)").first()
    assert tuple(zero) == (0, 0.0)
