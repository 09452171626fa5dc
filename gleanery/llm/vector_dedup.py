"""Embedding near-dedup with randomised-rotation binary codes.

Vectors that share a label are compared. A unit vector is rotated at random and kept as
the packed signs of its coordinates with a correction factor <code, vector>; both are stored
beside it once. From a stored code and the other vector follows an unbiased estimate of their
inner product and a bound on its error (the estimator of randomised-rotation codes). Pairs whose upper bound is below the
threshold are out; all others are recomputed exactly, in double precision, on the
original vectors, so no pair below the threshold is linked.

Equal vectors of one label are one node with a count, named by a hash; a second hash tells
whether two nodes share a name, and if so other hashes are taken. The nodes of a label are cut into
blocks by a hash, pairs of blocks are tasks of their own, and a task returns only the
number of partners of each node and a forest of its links, never pairs. A label with a
third of all rows is many blocks. Work in a label grows with the square of its distinct
vectors, one estimate a pair; nothing else does.

With SURE standard errors a pair at the threshold is missed with a chance below 1e-6.

Defined results: null, zero and non-finite vectors and those with a null label link with
nothing; vectors of unequal length don't link; repeated rows with one id are copies that
link with each other; other columns are never read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.components import components, roots
from gleanery.llm.store import dropped, written

#: Vectors of a block, rows of a tile inside a task, standard errors of the bound, and the rotation's seed.
BLOCK, TILE, SURE, SEED = 8192, 1024, 5.0, 11


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of rotated unit vectors, and the correction factors <code, vector>."""
    rotated = unit @ rotation(unit.shape[1])
    return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(unit.shape[1])


def codes(packed: np.ndarray, dim: int) -> np.ndarray:
    """Codes as vectors of length one: signs / sqrt(dim)."""
    return (2.0 * np.unpackbits(packed, axis=1, count=dim) - 1) / np.sqrt(dim)


def bounds(code: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of coded vectors (rows) with rotated ones (columns), and the error bound of each row."""
    dim = code.shape[1]
    estimate = (code @ rotated.T) / factor[:, None]
    return estimate, SURE * np.sqrt(np.clip(1 - factor**2, 0, 1)) / factor / np.sqrt(max(1, dim - 1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a with those of b, each scaled by its largest component first, so squares neither overflow nor vanish."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, code: np.ndarray, factor: np.ndarray, least: float, same: bool):
    """Places (i, j) of linked rows of a (with their codes and factors) and b, tile by tile; if same, only i < j."""
    rotated = units(b) @ rotation(b.shape[1])
    for s in range(0, len(a), TILE):
        for t in range(s if same else 0, len(b), TILE):
            estimate, error = bounds(code[s : s + TILE], factor[s : s + TILE], rotated[t : t + TILE])
            i, j = np.nonzero(estimate + error[:, None] >= least)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            sure = np.zeros(len(i), dtype=bool)
            for p in range(0, len(i), 65536):
                sure[p : p + 65536] = cosines(a[i[p : p + 65536]], b[j[p : p + 65536]]) >= least
            yield i[sure], j[sure]


def _valid(embedding):
    """The vector as doubles where it takes part: not null, finite, not zero."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(fine, v)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _named(rows: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of rows (k, label, v): k with its node, and the nodes with label, v, dim, copies, code and factor."""
    fits = F.col("label").isNotNull() & F.col("v").isNotNull()
    named = rows.withColumns({"node": F.when(fits, F.xxhash64(F.lit(seed), "label", "v")), "second": F.xxhash64("v", F.lit(seed), "label")})
    first = named.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("second").alias("s0"), F.max("second").alias("s1"))
    first = first.select("node", "label", "v", F.size("v").alias("dim"), "copies", (F.col("s0") != F.col("s1")).alias("shared"))
    schema = T.StructType([*first.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType())])

    def run(batches):
        for batch in batches:
            dims, code, factor = np.asarray(batch.column(3)), [None] * batch.num_rows, np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                where = np.flatnonzero(dims == d)
                packed, factor[where] = coded(units(_matrix(batch.column(2).take(pa.array(where)))))
                for i, c in zip(where.tolist(), packed, strict=True):
                    code[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(factor)], names=schema.names)

    nodes = written(first.mapInArrow(run, schema))
    if not nodes.where("shared").isEmpty():
        dropped(nodes)
        return _named(rows, seed + 1)
    return written(named.select("k", "node")), nodes


def groups(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """Per row: key, n_links, component_id (smallest key reachable) and kept."""
    rows = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), _valid(embedding).alias("v"))
    members, nodes = _named(rows)
    # One row for each label and length, to the tasks by a join.
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = nodes.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = placed.select("node", "label", "dim", "v", "code", "factor", "copies", "own", partner).select("*", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def run(_, found):
        own, p, q = (np.asarray(found.column(c)) for c in ("own", "p", "q"))
        node, copies, v = np.asarray(found.column("node")), np.asarray(found.column("copies")), _matrix(found.column("v"))
        same = p[0] == q[0]
        one, two = own == p[0], own == q[0]
        at, bt = np.flatnonzero(one), np.flatnonzero(two)
        partners, x, y = np.zeros(len(node), dtype=np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(at) and len(bt):
            packed = np.frombuffer(b"".join(found.column("code").take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), -1)
            factor = np.asarray(found.column("factor"))[at]
            for i, j in linked(v[at], v[bt], codes(packed, v.shape[1]), factor, least, same):
                i, j = at[i], bt[j]
                partners += np.bincount(i, weights=copies[j], minlength=len(node)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(node)).astype(np.int64)
                if len(i):
                    x, y = roots(np.r_[x, node[i]], np.r_[y, node[j]])
        up = dict(zip(x.tolist(), y.tolist(), strict=True))
        has = np.flatnonzero(partners)
        return pa.table({"node": pa.array(node[has], pa.int64()), "partners": pa.array(partners[has], pa.int64()), "root": pa.array([up.get(n, n) for n in node[has].tolist()], pa.int64())})

    found = written(tasks.groupBy("label", "dim", "p", "q").applyInArrow(run, "node long, partners long, root long"))
    linked_to = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    whole = components(found.select("node", "root"))
    # Written, these tables meet the vectors in plain joins, whose hot keys Spark splits.
    known = written(nodes.select("node", "copies").join(linked_to, "node", "left").join(whole, "node", "left"))
    for t in (nodes, found, whole):
        dropped(t)
    base = members.join(known, "node", "left")
    base = base.select("k", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("partners", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("c"))
    smallest = written(base.where("c is not null").groupBy("c").agg(F.min("k").alias("m")))
    out = base.join(smallest, "c", "left").select(F.col("k").alias(key), "n_links", F.coalesce("m", "k").alias("component_id"))
    out = written(out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))
    for t in (members, known, smallest):
        dropped(t)
    return out


#: The same in DuckDB, pair by pair.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(low.m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(low.m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN low ON low.x = v.vec_id
"""
