import numpy as np

from gleanery.llm import near_dup
from gleanery.llm.components import components


def sets_of(docs, k):
    out = []
    for i, text, *_ in docs:
        w = (text or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute(docs, k):
    """Smallest key of the group of each row."""
    rows = sets_of(docs, k)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        least[r] = min([x for x in (least.get(r), key) if x is not None], default=None)
    return [(rows[i][0], len(rows[i][1]), least[root(i)]) for i in range(len(rows))]


def test_groups_equal_brute_force(spark, corpus, documents):
    for k in (2, 5):
        got = near_dup.groups(documents, k=k).collect()
        order = lambda rows: sorted((a is None, a or 0, n, c is None, c or 0) for a, n, c in rows)
        assert order((r.k, r.n_shingles, r.component_id) for r in got) == order(brute(corpus[0], k))
        assert all(r.kept == (r.k == r.component_id) for r in got)


def test_tiles_find_what_stars_miss(spark, monkeypatch):
    """A chain of near copies: the ends aren't alike, so centres miss links that only pairs show. Blocks of 4 members split the bucket."""
    monkeypatch.setattr(near_dup, "TILE", 4)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(24):
        docs.append((i, " ".join(words)))
        words[(i * 7) % 200] = f"new{i}"
        words[(i * 11 + 3) % 200] = f"other{i}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.k: r.component_id for r in near_dup.groups(df, k=2).collect()}
    assert got == {i: c for i, _, c in brute(docs, 2)}


def test_one_document_of_each_group_stays(spark, documents, corpus):
    out = near_dup.deduplicated(documents, k=5)
    assert out.columns == documents.columns
    kept = out.collect()
    groups = {c for i, n, c in brute(corpus[0], 5) if n}
    wordless = sum(1 for _, n, _ in brute(corpus[0], 5) if not n)
    assert len(kept) == len(groups) + wordless
    assert near_dup.deduplicated(documents.where("false")).count() == 0 and near_dup.groups(documents.where("false")).count() == 0


def test_estimates(spark):
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            base = rng.integers(0, 2**63, 600, dtype=np.uint64)
            n = int(2 * 500 * share / (1 + share))
            a, b = base[:500], np.r_[base[:n], rng.integers(0, 2**63, 500 - n, dtype=np.uint64)]
            x, y = near_dup.registers(np.unique(a)), near_dup.registers(np.unique(b))
            assert (near_dup.merged(x, y) == near_dup.registers(np.unique(np.r_[a, b]))).all()
            found.append(near_dup.estimated(x[None], y[None], np.array([500.0]), np.array([500.0]))[0])
        assert abs(np.mean(found) - share) < 0.03, (share, np.mean(found))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, 2000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in edges:
            m = min(group[a], group[b])
            if group[a] != m or group[b] != m:
                group[a] = group[b] = m
                change = True
    assert got == {n: c for n, c in group.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
