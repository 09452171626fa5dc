"""Vector code compression: product codebooks in exact integers, assigned by Exponion search.

A component x becomes the integer floor(4096 * x). Vectors are cut into equal consecutive parts,
each with a codebook that starts as that part of the first vectors by id. In each round every part
goes to the nearest entry of its codebook and every entry becomes the floor of its parts' mean.

The search starts at the entry a part had in the round before, at squared distance u. Another entry
nearer than that, or as near, lies within twice the distance of the old entry (triangle inequality), so only the
entries whose squared distance to it is 4u or less are looked at, in the order of its distance-sorted
list of neighbours, which ends the scan. All distances are integers, so a tie is a tie, and goes to the lower index.

Each round's codes are written beside the vectors, so the next starts from them and a lost executor
costs its own tasks only. Tasks send one sum an entry; codebooks, of fixed size, are all that the driver holds.

Defined results: null vectors and those with null, NaN or infinite entries are dropped, as are those with
entries of 2^41 or more, whose doubles are whole steps apart. Ids that repeat start codebooks in the order
of their vectors, null ids last; fewer vectors than entries give smaller codebooks. Vectors of each length have codebooks of their own;
where the length isn't a multiple of the parts, part p begins at floor(p * length / parts). An error beyond
a long is null. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.store import dropped, written
from gleanery.llm.vector_dedup import _matrix

#: Steps of a component in one unit, parts of a vector, entries of a codebook, and rounds.
STEPS, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are searched at once.
CHUNK = 8192


def stepped(embedding: str):
    """The vector's integers, as longs; null where it takes no part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**53 // STEPS)))
    return F.when(fine, F.transform(v, lambda c: F.floor(c * STEPS).cast("long")))


def cuts(dim: int) -> list[tuple[int, int]]:
    """Where the parts of a vector of this length begin and end."""
    return [(p * dim // PARTS, (p + 1) * dim // PARTS) for p in range(PARTS)]


def _squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


class Book:
    """The entries of one part, and for each of them the others by distance and index, with the squared distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = _squares(entries[:, None] - entries[None])
        k = len(entries)
        order = [sorted((j for j in range(k) if j != i), key=lambda j: (apart[i, j], j)) for i in range(k)]
        self.near = np.array(order, dtype=np.int64).reshape(k, k - 1)
        self.apart = np.array([[apart[i, j] for j in row] for i, row in enumerate(order)], dtype=entries.dtype).reshape(k, k - 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each row of x, searched from start; and how many entries were looked at."""
        first = _squares(x - self.entries[start])
        best, least, seen = start.copy(), first.copy(), len(x)
        rows = np.arange(len(x))
        for j in range(self.near.shape[1]):
            rows = rows[self.apart[start[rows], j] <= 4 * first[rows]]
            if not len(rows):
                break
            entry = self.near[start[rows], j]
            far = _squares(x[rows] - self.entries[entry])
            better = (far < least[rows]) | ((far == least[rows]) & (entry < best[rows]))
            at = rows[better]
            best[at], least[at] = entry[better], far[better]
            seen += len(rows)
        return best, least, seen


def exact(x: np.ndarray, books: list[list[list[int]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vectors and codebooks in 64 bits where every square fits, as Python's integers where not."""
    most = max([abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *(abs(c) for book in books for entry in book for c in entry)])
    kind = np.int64 if 4 * (2 * most) ** 2 * max(1, x.shape[1]) < 2**62 else object
    return x.astype(kind), [np.array(book, dtype=kind).reshape(len(book), -1) for book in books]


def searched(x: np.ndarray, start: np.ndarray, books: list[list[list[int]]]) -> tuple[np.ndarray, list[int]]:
    """Codes of vectors, from the codes they had, and the sums of squared distances."""
    x, arrays = exact(x, books)
    codes, errors = np.empty_like(start), np.zeros(len(x), dtype=object)
    for p, (i, j) in enumerate(cuts(x.shape[1])):
        book = Book(arrays[p])
        for s in range(0, len(x), CHUNK):
            codes[s : s + CHUNK, p], least, _ = book.nearest(x[s : s + CHUNK, i:j], start[s : s + CHUNK, p].astype(np.int64))
            errors[s : s + CHUNK] += least.astype(object)
    return codes, errors.tolist()


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, PARTS)


def _assigned(rows: DataFrame, books: list[list[list[int]]], final: bool = False) -> DataFrame:
    """rows (id, label, x, code) with new codes; finally with hexadecimal ones and the error in place of x."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["id", "label", "code", "error"] if final else ["id", "label", "x", "code"]
    kinds |= {"code": "string" if final else "binary", "error": "long"}

    def run(batches):
        for batch in batches:
            code, error = searched(_matrix(batch.column("x")), _codes(batch.column("code")), books)
            found = {"id": batch.column("id"), "label": batch.column("label"), "x": batch.column("x")}
            found["code"] = pa.array([c.tobytes().hex() for c in code], pa.string()) if final else pa.array([c.tobytes() for c in code], pa.binary())
            found["error"] = pa.array([e if e < 2**63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([found[n] for n in names], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def _means(rows: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """Codebooks whose used entries are the floors of their parts' means. Tasks sum first, so an entry gets one row from each."""

    def run(batches):
        n, sums = None, None
        for batch in batches:
            x, code = _matrix(batch.column("x")), _codes(batch.column("code"))
            if n is None:
                n, sums = np.zeros((PARTS, ENTRIES), dtype=np.int64), np.zeros((ENTRIES, x.shape[1]), dtype=object)
            # Sums of up to 2^10 components below 2^53 fit in 64 bits; beyond, Python's integers carry on.
            for s in range(0, len(x), 1024):
                for p, (i, j) in enumerate(cuts(x.shape[1])):
                    one, each = code[s : s + 1024, p], np.zeros((ENTRIES, j - i), dtype=np.int64)
                    np.add.at(each, one, x[s : s + 1024, i:j])
                    sums[:, i:j] += each.astype(object)
                    n[p] += np.bincount(one, minlength=ENTRIES)
        if n is not None and sums.shape[1]:
            found = [(p, e, int(n[p, e]), at, str(sums[e, at])) for p, (i, j) in enumerate(cuts(sums.shape[1])) for e in np.flatnonzero(n[p]).tolist() for at in range(i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["part", "entry", "n", "at", "s"])

    each = rows.select("x", "code").mapInArrow(run, "part long, entry long, n long, at long, s string")
    # A row for each component of each entry: the size of the codebooks.
    begin = [i for i, _ in cuts(sum(len(book[0]) for book in books))]
    out = [[list(entry) for entry in book] for book in books]
    for row in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[row.part][row.entry][row.at - begin[row.part]] = int(row.s) // row.n
    return out


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def _coded(rows: DataFrame, dim: int, rounds: int) -> DataFrame:
    """id, label, code, error and codebooks_sha256 of the rows (id, label, x) of one length, as a table."""
    first = [r.x for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()]
    books = [[[int(c) for c in x[i:j]] for x in first] for i, j in cuts(dim)]
    now = rows.withColumn("code", F.lit(bytearray(PARTS)))
    for r in range(rounds):
        before, now = now, written(_assigned(now, books))
        if r:
            dropped(before)
        books = _means(now, books)
    out = written(_assigned(now, books, final=True).withColumn("codebooks_sha256", F.lit(digest(books))))
    if rounds:
        dropped(now)
    return out


def compressed(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Per row: key, code, error, label_error and codebooks_sha256."""
    rows = written(vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), stepped(embedding).alias("x")).where("x is not null"))
    found = [_coded(rows.where(F.size("x") == dim), dim, rounds) for (dim,) in rows.select(F.size("x").alias("dim")).distinct().collect()]
    dropped(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    every = found[0] if found else rows.sparkSession.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")
    for one in found[1:]:
        every = every.unionByName(one)
    # One row a label. Rows meet it in a plain join, whose hot keys Spark splits.
    of_label = written(every.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.max(F.col("error").isNull()).alias("over")))
    joined = every.alias("e").join(of_label.alias("l"), F.col("e.label").eqNullSafe(F.col("l.label")))
    total = F.when(~F.col("l.over"), F.expr("try_cast(l.s AS bigint)"))
    out = written(joined.select(F.col("e.id").alias(key), "code", "error", total.alias("label_error"), "codebooks_sha256"))
    for one in (of_label, *found):
        dropped(one)
    return out


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB: every part meets every entry of its codebook."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT k, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT k, x.p, e, list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts x JOIN b{r} b ON x.p = b.p
  ) GROUP BY k, p
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT x.p, a.best.e AS e, i, (sum(x.x[i])::BIGINT - ((sum(x.x[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM parts x JOIN a{r} a ON x.k = a.k AND x.p = a.p, unnest(range(1, len(x.x) + 1)) AS r(i) GROUP BY ALL
  ) GROUP BY p, e
), b{r + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (SELECT k, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x FROM kept, range({PARTS}) AS r(p)),
b0 AS (SELECT p, k - 1 AS e, x AS c FROM parts WHERE k <= {ENTRIES}),
{", ".join(steps)}, coded AS (
  SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY k
), books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (k), books
"""


ORACLE_SQL = oracle_sql()
