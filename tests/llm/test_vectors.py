import numpy as np
import pyarrow as pa

from gleanery.llm import neighbours, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, k string"


def rows():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24)).astype(np.float32)
    out = [(i, base[i].tolist(), i % 3, "clash") for i in range(300)]
    for i in range(60):  # near copies around the threshold, in one label or two
        near = base[i] + rng.standard_normal(24).astype(np.float32) * rng.choice([0.1, 0.35, 0.4])
        out.append((300 + i, near.tolist(), i % 3 if i % 5 else (i + 1) % 3, "clash"))
    out += [(400 + i, base[7].tolist(), 1, "clash") for i in range(12)]
    out += [(500, None, 1, "c"), (501, [0.0] * 24, 1, "c"), (502, [float("nan")] * 24, 1, "c"), (503, [None] + [1.0] * 23, 1, "c"), (504, base[7].tolist(), None, "c"), (505, [1.0, 2.0], 1, "c"), (506, [], 1, "c"), (507, [1e30] * 24, 0, "c"), (508, [3e30] * 24, 0, "c"), (509, [1e-30] * 24, 0, "c"), (510, [float("inf")] * 24, 0, "c")]
    return out


def unit(v):
    v = np.array(v, dtype=float)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_groups_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    ok = {i: (unit(v), lab) for i, v, lab, _ in data if usable(v) and lab is not None}
    links = {i: [j for j, (b, m) in ok.items() if j != i and m == lab and len(b) == len(a) and a @ b >= 0.93] for i, (a, lab) in ok.items()}
    comp = {r[0]: r[0] for r in data}
    for _ in range(len(data)):
        new = {i: min([c, *(comp[j] for j in links.get(i, []))]) for i, c in comp.items()}
        if new == comp:
            break
        comp = new
    for block in (2048, 40):  # one block a label, or many
        got = {r.vec_id: r for r in vector_dedup.groups(df, block=block).collect()}
        assert len(got) == len(data)
        for i in got:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, [])), comp[i], comp[i] == i), i
    assert vector_dedup.groups(df.where("false")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = (vector_dedup.units(rng.standard_normal((400, 64))) for _ in range(2))
    b[:200] = vector_dedup.units(a[:200] + 0.05 * b[:200])
    packed, factor = vector_dedup.coded(a)
    estimate, error = vector_dedup.bounds(vector_dedup.codes(packed, 64), factor, b @ vector_dedup.rotation(64))
    off = estimate - a @ b.T
    assert (np.abs(off) <= error[:, None]).mean() > 0.9999 and abs(off.mean()) < 0.002  # unbiased


def cosine(a, b):
    """Straight as the contract has it where squares neither overflow nor vanish."""
    with np.errstate(all="ignore"):
        plain = np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)))
    return float(plain) if np.isfinite(plain) else float(neighbours.cosines(a, b[None])[0])


def test_neighbours(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), block=100).collect()
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v, *_ in data if usable(v)}
    hits = total = 0
    for q in (i for i in ok if i % 50 == 0):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        near = sorted(((cosine(ok[q], v), -i) for i, v in ok.items() if i != q and len(v) == len(ok[q])), reverse=True)[:5]
        assert [r.rank for r in mine] == list(range(1, len(near) + 1))
        assert all(r.score == cosine(ok[q], ok[r.vec_id]) for r in mine)
        assert [(r.score, -r.vec_id) for r in mine] == sorted([(r.score, -r.vec_id) for r in mine], reverse=True)
        hits += len({r.vec_id for r in mine} & {-i for _, i in near})
        total += len(near)
    assert hits / total >= 0.9
    assert {r.query_id for r in got} == {i for i in ok if i % 50 == 0}
    few = spark.createDataFrame(data[:3], SCHEMA)
    assert neighbours.search(few, few.where("vec_id = 0")).count() == 2
    assert neighbours.search(df.where("false"), df.where("false")).count() == 0


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 2**16, (500, 4), dtype=np.uint16)
    index = neighbours.Index(codes)
    assert (index.bits, index.parts) == (9, 8)
    for q in rng.integers(0, 2**16, (5, 4), dtype=np.uint16):
        far, found = np.bitwise_count(codes ^ q).sum(axis=1), set()
        for radius, places in index.levels(q):
            assert not found & set(places.tolist()) and len(places) == len(set(places.tolist()))
            found |= set(places.tolist())
            assert found == set(np.flatnonzero(far <= radius).tolist())
        assert len(found) == 500


def test_scaled_copies_come_in_the_order_of_their_scores():
    rng = np.random.default_rng(8)
    for case in range(60):
        v = rng.standard_normal((400, 16))
        query = rng.standard_normal(16)
        copies = rng.choice(400, 40, replace=False)
        v[copies] = (query + 0.1 * rng.standard_normal(16)) * rng.choice([1, 3, 0.7, 5.1, 0.11], 40)[:, None]
        rotation = neighbours.learned(vector_dedup.units(v))
        block = neighbours.Block(pa.array(range(400)), v, neighbours.coded(vector_dedup.units(v), rotation))
        unit = vector_dedup.units(query[None])
        places = block.nearest(neighbours.coded(unit, rotation)[0], unit[0], -1, 5, 256)
        score = neighbours.cosines(query, v)
        want = np.lexsort((np.arange(400), -score))[:5]
        assert places[np.lexsort((places, -score[places]))[:5]].tolist() == want.tolist(), case


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 8))
    rows = [(i, base[i].tolist()) for i in range(40)] + [(None, base[0].tolist()), (None, base[1].tolist()), (100, (base[2] * 1e200).tolist()), (102, (base[3] * 1e-200).tolist()), (0, base[5].tolist()), (104, base[9].tolist()), (104, base[9].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 2 = 0"), k=3).collect()
    assert all(np.isfinite(r.score) and r.score <= 1 + 1e-12 for r in got)
    first = {(r.query_id): r for r in got if r["rank"] == 1}
    assert first[2].vec_id == 100 and abs(first[2].score - 1) < 1e-12 and first[100].vec_id == 2 and first[102].vec_id == 3
    # A row without an id is found like others, ids first in ties; a query's own id isn't found, not even in another row.
    assert [r.vec_id for r in got if r.query_id == 0 and r.score > 1 - 1e-12] == [None, 5]
    assert not [r for r in got if r.query_id == r.vec_id] and len([r for r in got if r.query_id == 104]) == 3
    by_name = df.selectExpr("cast(vec_id as string) as name", "embedding")
    assert neighbours.search(by_name, by_name.where("name is null"), key="name", k=2).count() == 4


def shares(unit, queries=100):
    """Recall, and of all rows and queries the shares that buckets gave and that were reranked."""
    codes = neighbours.coded(unit, neighbours.learned(unit[:2000]))
    block = neighbours.Block(pa.array(range(len(unit))), unit, codes)
    hit, ranked, levels = 0, 0, block.index.levels

    def counting(code):
        nonlocal ranked
        for radius, places in levels(code):
            ranked += len(places)
            yield radius, places

    block.index.levels = counting
    for q in range(queries):
        places = block.nearest(codes[q], unit[q], q, 5, 256)
        want = np.sort(np.delete(unit @ unit[q], q))[-5:]
        hit += len(set(np.sort(unit[places] @ unit[q]).round(12)) & set(want.round(12)))
    return hit / (5 * queries), block.index.retrieved / (queries * len(unit)), ranked / (queries * len(unit))


def test_recall_and_share():
    rng = np.random.default_rng(3)
    recall, probed, ranked = shares(vector_dedup.units(rng.standard_normal((6000, 64))))
    print("random", recall, probed, ranked)
    assert recall >= 0.9 and ranked < 0.3
    # Where a query has near neighbours the radius stays small, and most rows are never met.
    centres = rng.standard_normal((300, 64))
    recall, probed, ranked = shares(vector_dedup.units(np.repeat(centres, 20, axis=0) + 0.15 * rng.standard_normal((6000, 64))))
    print("clustered", recall, probed, ranked)
    assert recall >= 0.9 and probed < 0.3 and ranked < 0.02
