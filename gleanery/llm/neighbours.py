"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation, from as many random starts as
it takes) turn unit vectors into binary codes of CODE bits or more. Every row is coded once;
its code is stored beside it. Codes are cut into substrings as long as the logarithm of the
block's rows (8 to 16 bits), and a block of the table has one index for each substring. By the pigeonhole principle a code within Hamming
radius r of a query is within r // substrings of it in at least one substring. Buckets are probed
by growing distance in their substrings: after distance a, every code within substrings * (a + 1) - 1
has been retrieved. Retrieved codes are compared in full, and vectors of those within the radius
are reranked by cosine in double precision.

The radius grows from the smallest until it is enough: once the
fifth cosine found so far is known, a code farther away than that angle makes likely (by SURE
standard errors) can't be nearer. Rows as near as the fifth but for rounding are all scored exactly, so
copies, scaled ones included, come in the order of their exact scores.

The query set is stated by the caller and meets all rows block by block. A row of the table
goes to one block, and queries stream past the block's index in batches; a block's bytes are
bounded, so memory is whatever the number of queries. Queries are cut into chunks only beyond
CHUNK of them, so that a task's time has a bound too.

Defined results: null, zero and non-finite vectors take no part, nor do queries of their
kind; vectors of another length than a query's are no candidates; huge and tiny components
neither overflow nor vanish; ties go to the smaller id, null last; with fewer candidates than
wanted all are returned; rows that share an id stand for rows of their own, but a query never
finds a row with its own id; queries equal in id and vector are one.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.store import dropped, spread, written
from gleanery.llm.vector_dedup import _matrix, _valid, units

#: Rows of the sample the rotations are learned on, rounds of learning, bits of a substring and of a code at least.
SAMPLE, ROUNDS, BITS, CODE = 4096, 25, 16, 256
#: Bytes of the vectors of a block at most and rows of it at least, queries of a chunk.
BLOCK_BYTES, BLOCK_ROWS, CHUNK = 64 << 20, 4096, 1 << 22
#: Bits of a substring at least, and cosines that may be equal but for rounding.
SHORTEST, EQUAL = 8, 1e-9
#: Standard errors of the stopping rule, and the seed.
SURE, SEED = 2.0, 5


def learned(sample: np.ndarray, dim: int | None = None) -> np.ndarray:
    """Rotations beside each other, under which the signs of the sample's coordinates lose least: one column a bit."""
    dim = sample.shape[1] if dim is None else dim
    out = []
    for start in range(-(-CODE // dim)):
        r = np.linalg.qr(np.random.default_rng([SEED, start]).standard_normal((dim, dim)))[0]
        for _ in range(ROUNDS if len(sample) else 0):
            code = np.where(sample @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(sample.T @ code)
            r = u @ w
        out.append(r)
    return np.concatenate(out, axis=1)


def coded(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Substrings of the codes: one 16-bit number for every 16 bits, the last filled up with zeros; a multiple of four of them."""
    signs = unit @ rotation >= 0
    padded = np.zeros((len(signs), -(-signs.shape[1] // 64) * 64), dtype=bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded.reshape(len(signs), -1, BITS), axis=2, bitorder="little").view(np.uint16)[:, :, 0]


@cache
def masks(bits: int) -> list[np.ndarray]:
    """All numbers of so many bits, by their number of ones."""
    ones = np.bitwise_count(np.arange(1 << bits))
    return [np.flatnonzero(ones == n) for n in range(bits + 1)]


class Index:
    """Bucket directories of one block of codes, one for each substring, beside each other in one array."""

    def __init__(self, codes: np.ndarray):
        self.whole, self.total = np.ascontiguousarray(codes).view(np.uint64), codes.shape[1] * 16
        self.bits = int(np.clip(np.round(np.log2(max(2, len(codes)))), SHORTEST, BITS))
        self.parts = -(-self.total // self.bits)
        keys = self.cut(codes)
        #: Rows by substring and bucket, and where each bucket begins.
        self.order = np.argsort(keys.T.ravel(), kind="stable") % max(1, len(codes))
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(keys.ravel(), minlength=self.parts << self.bits))])
        #: Buckets probed and rows retrieved so far, for tests and figures.
        self.probed, self.retrieved = 0, 0

    def cut(self, codes: np.ndarray) -> np.ndarray:
        """Bucket numbers of codes, a column a substring. The last one's missing bits are zeros."""
        raw = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")
        raw = np.pad(raw, ((0, 0), (0, self.parts * self.bits - raw.shape[1]))).reshape(len(codes), self.parts, self.bits)
        return (raw @ (1 << np.arange(self.bits))) + (np.arange(self.parts) << self.bits)

    def probe(self, keys: np.ndarray, distance: int) -> np.ndarray:
        """Places in all buckets at this distance from a query's in their substrings; a place may come more than once."""
        buckets = (keys[:, None] ^ masks(self.bits)[distance]).ravel()
        begin = self.begin[buckets]
        n = self.begin[buckets + 1] - begin
        held = n > 0
        begin, n = begin[held], n[held]
        ends = np.cumsum(n)
        self.probed += len(buckets)
        return self.order[np.arange(ends[-1]) + np.repeat(begin - ends + n, n)] if len(n) else np.empty(0, np.int64)

    def levels(self, query: np.ndarray):
        """Radius after radius, the places of all codes within it that weren't within the one before."""
        keys, seen, code = self.cut(query[None])[0], np.zeros(len(self.whole), bool), np.ascontiguousarray(query).view(np.uint64)
        waiting, far = np.empty(0, np.int64), np.empty(0, np.int64)
        for distance in range(self.bits + 1):
            hit = np.zeros(len(seen), bool)
            hit[self.probe(keys, distance)] = True
            new = np.flatnonzero(hit & ~seen)
            seen[new] = True
            self.retrieved += len(new)
            waiting, far = np.r_[waiting, new], np.r_[far, np.bitwise_count(self.whole[new] ^ code).sum(axis=1)]
            radius = self.parts * (distance + 1) - 1
            inside = far <= radius
            yield radius, waiting[inside]
            waiting, far = waiting[~inside], far[~inside]


def enough(cosine: float, bits: int, sure: float = SURE) -> int:
    """The Hamming radius inside which, but for so many standard errors, every vector at least so near lies."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return min(bits, int(np.ceil(bits * p + sure * np.sqrt(bits * p * (1 - p)) + 1)))


class Block:
    """The rows of a block, by place: vectors, unit vectors, codes and their index, ids as numbers (own) and in order (rank)."""

    def __init__(self, ids: pa.Array, v: np.ndarray, codes: np.ndarray):
        named = ids.dictionary_encode("encode")
        self.ids, self.names, self.v, self.unit, self.index = ids, named.dictionary, v, units(v), Index(codes)
        self.own = np.asarray(named.indices)
        self.rank = np.asarray(pc.rank(named.dictionary, null_placement="at_end"))[self.own].astype(np.int64)

    def nearest(self, code: np.ndarray, query: np.ndarray, own: int, k: int, bits: int) -> np.ndarray:
        """Places of the rows that may be the k nearest to one query (a unit vector)."""
        at, near = np.empty(0, np.int64), np.empty(0)
        for radius, new in self.index.levels(code):
            new = new[self.own[new] != own]
            at, near = np.r_[at, new], np.r_[near, self.unit[new] @ query]
            if len(at) < k:
                continue
            kth = np.partition(near, len(near) - k)[len(near) - k]
            at, near = at[near >= kth - EQUAL], near[near >= kth - EQUAL]
            if enough(kth, bits) <= radius:
                break
        return at


def coded_rows(df: DataFrame, key: str, embedding: str, rotations: dict[int, np.ndarray]) -> DataFrame:
    """id, v, dim and code of the rows whose vectors take part."""
    rows = df.select(F.col(key).alias("id"), _valid(embedding).alias("v")).where("v is not null").select("id", "v", F.size("v").alias("dim"))
    sent = df.sparkSession.sparkContext.broadcast(rotations)

    def run(batches):
        own = {}
        for batch in batches:
            dims, code = np.asarray(batch.column(2)), [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                rotation = sent.value.get(d)
                if rotation is None:  # a length that the sample lacks
                    rotation = own[d] = own[d] if d in own else learned(np.empty((0, d)))
                where = np.flatnonzero(dims == d)
                found = coded(units(_matrix(batch.column(1).take(pa.array(where)))), rotation)
                for i, c in zip(where.tolist(), found, strict=True):
                    code[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary())], names=["id", "v", "dim", "code"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, v array<double>, dim int, code binary")


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 5, block: int | None = None) -> DataFrame:
    """For each row of queries its k nearest rows of vectors: query_id, rank, vec_id (named after key), score. block: rows of a block, for tests."""
    rows = vectors.select(F.col(key).alias("id"), _valid(embedding).alias("v")).where("v is not null").select("id", "v", F.size("v").alias("dim"))
    # A bounded sample by hash, the same in each run; only hashes are ordered. Equal rows come along, so it is cut to size again.
    few = F.broadcast(rows.select(F.xxhash64("id", "v").alias("_h")).distinct().orderBy("_h").limit(SAMPLE))
    picked = rows.join(few, F.xxhash64("id", "v") == F.col("_h"), "left_semi").select("v", "dim").dropDuplicates(["v"]).orderBy("v").limit(SAMPLE).toArrow()
    dims = np.asarray(picked.column("dim"))
    rotations = {int(d): learned(units(np.array(picked.column("v").filter(pa.array(dims == d)).to_pylist()))) for d in np.unique(dims)}
    data, coded_queries = (written(coded_rows(df, key, embedding, rotations)) for df in (vectors, queries))
    asked = coded_queries.dropDuplicates(["id", "v"])
    # Blocks as many as the vectors' bytes need; where that is few, as many as there are tasks, so that all work.
    least = F.ceil(F.count("*") / F.greatest(F.lit(1).cast("long"), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("dim"))))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.count("*") / F.lit(block)) if block else F.greatest(least, F.least(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.lit(tasks).cast("long")))
    sizes = data.groupBy("dim").agg(blocks.cast("int").alias("blocks"))
    counts = written(sizes.join(asked.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks")), "dim"))
    name = F.xxhash64("id", "v")
    rows = data.join(counts, "dim").select("id", "v", "code", "dim", F.pmod(name, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"))
    ask = asked.join(counts, "dim").select("id", "v", "code", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(name, F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"))
    kind = data.schema["id"].dataType.simpleString()

    def run(batches):
        held, at, now = [], None, None

        def answers(found: pa.RecordBatch, now: Block):
            v, dim = _matrix(found.column("v")), found.column("dim")[0].as_py()
            unit, code = units(v), np.frombuffer(b"".join(found.column("code").to_pylist()), dtype=np.uint16).reshape(len(v), -1)
            own = np.asarray(pc.fill_null(pc.index_in(found.column("id"), value_set=now.names), -1))
            out_q, out_d, out_s = [], [], []
            for q in range(len(v)):
                places = now.nearest(code[q], unit[q], own[q], k, -(-CODE // dim) * dim)
                score = cosines(v[q], now.v[places])
                best = np.lexsort((now.rank[places], -score))[:k]
                out_q += [q] * len(best)
                out_d += places[best].tolist()
                out_s += score[best].tolist()
            row = [hash_of(x) for x in v]
            return pa.RecordBatch.from_arrays([pa.array([row[q] for q in out_q], pa.int64()), found.column("id").take(pa.array(out_q, pa.int64())), now.ids.take(pa.array(out_d, pa.int64())), pa.array(out_s, pa.float64())], names=["query_row", "query_id", "id", "score"])

        for batch in batches:
            part = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("dim", "block", "chunk", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]).any(axis=1)) + 1).tolist(), len(part)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                group, some = tuple(part[i, :3].tolist()), batch.slice(i, j - i)
                if group != at:
                    held, at, now = [], group, None
                if not part[i, 3]:
                    held.append(some.select(["id", "v", "code"]))
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint16).reshape(table.num_rows, -1)
                    now, held = Block(table.column("id").combine_chunks(), _matrix(table.column("v")), code), []
                if now is not None:  # no rows, no neighbours
                    yield answers(some, now)

    place = ["dim", "block", "chunk"]
    some = spread(rows.unionByName(ask), *place).sortWithinPartitions(*place, "asks").mapInArrow(run, f"query_row long, query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    found = written(some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score"))
    for table in (data, coded_queries, counts):
        dropped(table)
    return found


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors over a power of two near their largest component, which changes no digit; their squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a vector with the rows of b, in double precision, as dot / (norm * norm)."""
    a = scaled(a)
    return np.array([float(np.dot(a, x) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(x, x)))) for x in scaled(b)]) if len(b) else np.empty(0)


def hash_of(v: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(v.tobytes())).view(np.int64))
