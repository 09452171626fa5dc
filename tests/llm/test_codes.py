"""Vector code compression and whitening against plain Python and numpy."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from gleanery.llm import compression, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id int, x string, code int, n string"


def rows(dim=16, many=300, seed=3):
    rng = np.random.default_rng(seed)
    v = (rng.standard_normal((many, dim)) * np.linspace(0.05, 0.4, dim)).astype(np.float32)
    out = [(i, v[i].tolist(), int(i % 4) if i % 7 else None, 1, "clash", 2, "clash") for i in range(many)]
    out += [(1000 + i, v[5].tolist(), 1, 1, "", 2, "") for i in range(150)]  # a hot vector and label
    nan, inf = float("nan"), float("inf")
    out += [(2000, None, 1, 1, "", 2, ""), (2001, [nan] * dim, 1, 1, "", 2, ""), (2002, [inf] * dim, 1, 1, "", 2, ""), (2003, [None] * dim, 1, 1, "", 2, ""), (2004, [0.0] * dim, None, 1, "", 2, "")]
    return out


def plain_compressed(table):
    """Row by row and entry by entry."""
    kept = sorted(((k, [math.floor(4096 * c) for c in v], g) for k, v, g, *_ in table if v is not None and all(c is not None and math.isfinite(c) for c in v)), key=lambda r: r[0])
    dim = len(kept[0][1])
    size = dim // 8
    part = lambda x, p: x[p * size : (p + 1) * size]
    books = [[part(x, p) for _, x, _ in kept[:16]] for p in range(8)]
    nearest = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(part(x, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        own = [[nearest(x, p)[1] for p in range(8)] for _, x, _ in kept]
        for p in range(8):
            for e in range(len(books[p])):
                if mine := [part(x, p) for (_, x, _), o in zip(kept, own, strict=True) if o[p] == e]:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out, of_label = {}, {}
    for k, x, g in kept:
        best = [nearest(x, p) for p in range(8)]
        out[k] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), g)
        of_label[g] = of_label.get(g, 0) + out[k][1]
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {k: (code, error, of_label[g], name) for k, (code, error, g) in out.items()}


@pytest.mark.parametrize("many", [300, 9])
def test_compression_equals_the_plain_rule(spark, many):
    table = rows(many=many)
    found = compression.compressed(spark.createDataFrame(table, SCHEMA).repartition(5)).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in found} == plain_compressed(table)
    assert len(found) == len(table) - 4


def test_compression_equals_its_sql(spark):
    table = rows(many=60)
    found = compression.compressed(spark.createDataFrame(table, SCHEMA)).toPandas()
    con = duckdb.connect()
    con.register("embeddings_", spark.createDataFrame(table, SCHEMA).select("vec_id", "embedding", "label").toArrow())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM embeddings_")
    want = con.execute(compression.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, found[["vec_id", "code", "error", "label_error", "codebooks_sha256"]].values.tolist())) == sorted(want)


def test_search_is_exact_and_leaves_entries_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    x = np.concatenate([x, (centres[:1] + centres[1:2]) // 2, centres])
    apart = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    start = rng.integers(0, 16, len(x))
    book = compression.Book(centres)
    best, least, _ = book.nearest(x, start)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    # From entries that are nearest already, the radius leaves most others out.
    again, _, seen = book.nearest(x, best)
    assert (again == best).all() and seen < 0.25 * 16 * len(x)


def test_search_ties_and_large_components():
    book = compression.Book(np.array([[0, 0], [4, 0], [0, 0], [2, 2]]))
    for start in range(4):
        best, least, _ = book.nearest(np.array([[2, 0], [0, 0], [1, 1]]), np.full(3, start))
        assert best.tolist() == [0, 0, 0] and least.tolist() == [4, 0, 2]
    big = 2**52
    books = [[[0], [big]] for _ in range(8)]
    codes, errors = compression.searched(np.array([[big] * 8, [-big] * 8]), np.zeros((2, 8), np.uint8), books)
    assert codes.tolist() == [[1] * 8, [0] * 8] and errors == [0, 8 * big**2]


def test_compression_of_empty_odd_and_mixed_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert compression.compressed(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and compression.compressed(none).count() == 0
    mixed = [(None, [1.0] * 8, 1, 1, "", 1, ""), (1, [1.0] * 8, 1, 1, "", 1, ""), (1, [1.0] * 8, 1, 1, "", 1, ""), (2, [0.5, 0.25], None, 1, "", 1, ""), (3, [], None, 1, "", 1, ""), (4, [1e6] * 8, 5, 1, "", 1, "")]
    found = compression.compressed(spark.createDataFrame(mixed, SCHEMA)).collect()
    assert len(found) == 6 and {r.error for r in found} == {0} and all(len(r.code) == 16 for r in found)


def plain_whitened(table):
    kept = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v, *_ in table if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(x) for x in kept.values()}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return kept, n, sums, values[order], vectors[:, order], values.sum()


def test_whitening_equals_a_plain_decomposition(spark):
    table = rows()
    kept, n, sums, values, vectors, trace = plain_whitened(table)
    found = whitening.whitened(spark.createDataFrame(table, SCHEMA).repartition(5)).collect()
    assert {r.n for r in found} == {n} and {(r.vec_id, r.component) for r in found} == {(k, c) for k in kept for c in range(1, 17)} and len(found) == 16 * len(kept)
    signs = {}
    for r in found:
        x, c = np.array(kept[r.vec_id]), r.component - 1
        want = float((x * n - sums) / n @ vectors[:, c] / np.sqrt(values[c]))
        sign = signs.setdefault(c, np.sign(want * r.whitened))
        assert r.whitened == pytest.approx(sign * want, rel=1e-7, abs=1e-9)
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(kept[r.vec_id], sums, strict=True))
        assert r.explained == pytest.approx(values[c] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
    hot = {r.whitened for r in found if r.component == 3 and (r.vec_id == 5 or 1000 <= r.vec_id < 1150)}
    assert len(hot) == 1


def test_whitening_of_few_flat_and_mixed_vectors(spark):
    make = lambda some: spark.createDataFrame([(k, v, 1, 1, "", 1, "") for k, v in some], SCHEMA)
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [])])).count() == 0
    flat = whitening.whitened(make([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (None, [3.0, 6.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0])])).collect()
    assert sorted((r.n, r.component) for r in flat) == [(2, 1), (2, 1), (3, 1), (3, 1), (3, 1)]
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(1) for r in flat)
    large = whitening.whitened(make([(1, [1e12, 0.0]), (2, [0.0, 1e-3]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation for r in large} == {None} and all(math.isfinite(r.whitened) for r in large)
