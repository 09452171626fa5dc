"""MinHash-like near-dedup with SetSketch registers.

A document's set holds its distinct word shingles. Registers are exponentially spaced,
truncated minima of hash values (SetSketch), so sketches merge by maxima and equal
registers hint at similar sets. Bands of registers propose pairs; the similarity of a
pair is estimated jointly from both sketches by maximum likelihood; pairs that may reach
the threshold are then verified on their full sets.

Documents with equal sets are one node. First, every member of a band's bucket meets the
bucket's smallest node: as many pairs as rows. What that links forms components. Then
only pairs of one bucket that lie in different components are left to try. They are
tried inside tasks that hold two blocks of one bucket, where links found make further
pairs needless; only links leave a task. So a large group of near copies isn't compared
pair by pair, yet no link is lost that the bands show.

With 25 bands of 5 registers a pair at similarity 0.8 is missed by all bands with a
chance of about 5e-5, at 0.9 below 1e-9. Pairs estimated more than MARGIN (four standard
errors) below the threshold aren't verified.

Defined results: null and empty texts, and texts without words, have the empty set and
link with nothing; fewer words than a shingle make one element; repeated rows belong to
one group. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.store import dropped, written

#: Registers are BANDS x ROWS; their spacing BASE, rate RATE and number of states are those of 16-bit registers.
BANDS, ROWS, BASE, RATE, STATES = 25, 5, 1.0005, 20.0, 65534
REGISTERS = BANDS * ROWS
MARGIN = 0.14
#: Members of a bucket that one block of it holds.
TILE = 1024
_rng = np.random.default_rng(20240607)
FLIP = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
TIMES = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
BAND_TIMES = _rng.integers(0, 2**63, (2, BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text in UTF-8; A to Z count as a to z."""
    words = text.lower().split() if text else []  # bytes: only ASCII letters and white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=k)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * M1
        out ^= out >> np.uint64(32)
        out *= M2
        out ^= out >> np.uint64(29)
    return np.unique(out)


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set."""
    low = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, ((low[i : i + 1024, None] ^ FLIP) * TIMES).min(axis=0), out=least)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, STATES + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of one sketch."""
    x = (sketch.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * BAND_TIMES[0]
    x ^= x >> np.uint64(31)
    x = (x * BAND_TIMES[1]).sum(axis=1, dtype=np.uint64)
    x ^= x >> np.uint64(32)
    return (x * M1).view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows of a and b) whose set sizes are known."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))

    lo, hi = np.zeros(len(a)), top
    for _ in range(25):  # the likelihood has one maximum
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def sketched(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """k (the key), h (hash of the text), n (set size), node (hash of the set, null if empty), sketch and bands."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, node, sketch, band = [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                if len(s):
                    r = registers(s)
                    node.append(int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))))
                    sketch.append(r.tobytes())
                    band.append(bands(r))
                else:
                    node.append(None)
                    sketch.append(None)
                    band.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["k", "h", "n", "node", "sketch", "bands"])

    return docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).cast("string")).mapInArrow(run, f"k {kind}, h long, n long, node long, sketch binary, bands array<long>")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of pairs (x, y) those whose estimated similarity is least or more."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            na, nb = (np.asarray(batch.column(i)).astype(float) for i in (4, 5))
            yield batch.select([0, 1]).filter(pa.array(estimated(a, b, na, nb) >= least))

    # Sizes bound the similarity from above, at no cost.
    joined = pairs.join(side("x"), "x").join(side("y"), "y").where(F.least("nx", "ny") >= least * F.greatest("nx", "ny"))
    return joined.select("x", "y", "sx", "sy", "nx", "ny").mapInArrow(run, "x long, y long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) those with 100 * intersection >= percent * union on the full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("x", "sx"), "x").join(sets.toDF("y", "sy"), "y")
    return joined.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def _links_of(tile: pa.Table, least: float, percent: int) -> list[tuple[int, int]]:
    """Links between the components of one tile: no pair twice, none that a link found before makes needless."""
    own, node, c, n = (np.asarray(tile.column(x)) for x in ("own", "node", "c", "n"))
    a, b = np.flatnonzero(own == tile.column("p")[0].as_py()), np.flatnonzero(own == tile.column("q")[0].as_py())
    if not len(a) or not len(b):
        return []
    sketch = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    band = np.asarray(tile.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
    earlier, sets = band[:, : tile.column("band")[0].as_py()], tile.column("set").combine_chunks()
    found, ahead = [], {}

    def root(x):
        while x in ahead:
            x = ahead[x]
        return x

    apart = c[a][:, None] != c[b][None, :]
    if own[a[0]] == own[b[0]]:
        apart &= node[a][:, None] < node[b][None, :]
    apart &= np.minimum(n[a][:, None], n[b][None, :]) >= least * np.maximum(n[a][:, None], n[b][None, :])
    for k in range(earlier.shape[1]):  # a pair that shares an earlier band is tried there
        apart &= earlier[a, k][:, None] != earlier[b, k][None, :]
    i, j = np.nonzero(apart)
    i, j = a[i], b[j]
    likely = np.concatenate([np.empty(0), *(estimated(sketch[i[k : k + 8192]], sketch[j[k : k + 8192]], n[i[k : k + 8192]].astype(float), n[j[k : k + 8192]].astype(float)) for k in range(0, len(i), 8192))])
    order = [k for k in np.argsort(-likely, kind="stable") if likely[k] >= least]
    for k in order:
        x, y = root(c[i[k]]), root(c[j[k]])
        if x != y:
            u, v = (np.frombuffer(sets[int(m)].as_buffer(), dtype=np.uint64) for m in (i[k], j[k]))
            common = len(np.intersect1d(u, v, assume_unique=True))
            if 100 * common >= percent * (len(u) + len(v) - common):
                ahead[x] = y
                found.append((int(node[i[k]]), int(node[j[k]])))
    return found


def _tiled(tiles: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (x, y) that are left between components, found inside tiles. A tile has the rows of two blocks of a bucket."""
    keys = ["band", "value", "p", "q"]

    def run(batches):
        held, at = [], None

        def done():
            found = _links_of(pa.Table.from_batches(held), least, percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["x", "y"])

        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                now = tuple(key[i].tolist())
                if held and now != at:
                    yield done()
                    held = []
                held.append(batch.slice(i, j - i))
                at = now
        if held:
            yield done()

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "x long, y long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: k, h (hash of the text), n_shingles, c (its group, null without words), component_id (smallest key reachable) and kept."""
    least = percent / 100 - MARGIN
    sketches = written(sketched(docs, key, text, k))
    nodes = sketches.where("node is not null").dropDuplicates(["node"]).select("node", "n", "sketch", "bands")
    rows = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band", "value", "lo")
    members = written(rows.join(shared, ["band", "value"]))
    active = members.select("node").distinct()
    sketch_of = written(nodes.select("node", "n", "sketch", "bands").join(active, "node"))

    # Copies of one set are summed up before anything is joined by it.
    firsts = sketches.where("node is not null").groupBy("node").agg(F.min(F.struct("k", "h")).alias("at"))
    place = firsts.join(active, "node").select(F.col("at.k").alias("ak"), F.col("at.h").alias("ah"))
    d = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("t"))

    def set_of(batches):
        for batch in batches:
            found = [shingles(t.as_py(), k) for t in batch.column(0).cast(pa.binary())]
            node = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "set"])

    texts = d.join(place, d.k.eqNullSafe(place.ak) & (d.h == place.ah)).select("t")
    sets = written(texts.mapInArrow(set_of, "node long, set binary").dropDuplicates(["node"]))

    first = members.where("node <> lo").select(F.col("lo").alias("x"), F.col("node").alias("y")).distinct()
    links = written(_verified(_likely(first, sketch_of, least), sets, percent))
    known = components(links)
    at = written(members.join(known, "node", "left").select("band", "value", "node", "lo", F.coalesce("component", "node").alias("c")))
    mixed = at.groupBy("band", "value").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 <> c1").select("band", "value", F.ceil(F.col("m") / F.lit(TILE)).cast("int").alias("blocks"))
    open_ = at.join(mixed, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    tiles = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.join(sketch_of, "node").join(sets, "node").select("band", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "c", "n", "sketch", "bands", "set")
    late = written(_tiled(tiles, least, percent))
    # Written, these tables meet the documents in plain joins, whose hot keys Spark splits.
    all_ = components(known.union(late.select("x", "y")))
    whole = written(all_)
    for t in (members, sketch_of, sets, links, known, at, late, all_):
        dropped(t)

    base = sketches.select("k", "h", "n", "node").join(whole, "node", "left").select("k", "h", "n", F.coalesce("component", "node").alias("c"))
    smallest = written(base.where("c is not null").groupBy("c").agg(F.min("k").alias("m")))
    found = base.join(smallest, "c", "left").select("k", "h", F.col("n").alias("n_shingles"), "c", F.coalesce("m", "k").alias("component_id")).withColumn("kept", F.col("k").eqNullSafe(F.col("component_id")))
    found = written(found)
    for t in (sketches, whole, smallest):
        dropped(t)
    return found


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one with the smallest key. Documents without words all stay."""
    found = groups(docs, key, text, k, percent)
    order = F.struct(F.col("k").isNull().alias("none"), "k", "h")
    winners = found.where("c is not null").groupBy("c").agg(F.min(order).alias("w")).select("w.k", "w.h")
    rows = found.groupBy("k", "h").agg(F.count("*").alias("rows"))
    w, r = winners.alias("w"), rows.alias("r")
    winners = written(w.join(r, F.col("w.k").eqNullSafe(F.col("r.k")) & (F.col("w.h") == F.col("r.h"))).select("w.k", "w.h", "r.rows"))
    words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def won(which):
        return docs.where(words).join(which, docs[key].eqNullSafe(which.k) & (F.xxhash64(docs[text]) == which.h), "left_semi")

    # Rows that are the same in key and text are one document; only they need a second look.
    return won(winners.where("rows = 1")).union(won(winners.where("rows > 1")).dropDuplicates([key, text])).union(docs.where(~words))


#: The same in DuckDB for two-word shingles, pair by pair.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) ELSE ws END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), links AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN low ON low.x = s.doc_id
"""
