"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Every source gets a target from its weight and its size. Targets turn
into integer numbers of equal-token blocks by the Sainte-Laguë rule (seats go to the
highest quotients votes / (2 seats + 1)), first among sources, then among the sections of
each source, then among the shards of each section. In a shard documents stand in a seeded
order on one line of words, cut into blocks; quotas beyond the shard's blocks repeat the
whole line, the rest is a seeded run of blocks. A document's words on chosen blocks are what
the mix takes of it.

A shard has about SHARD_DOCS documents at any input, so no line is long; there are as many
shards as that takes. Only one row per section reaches the driver, at most SECTIONS of each
source (the number of sources is that of given weights); the shards of a section get their
quotas in a task, and these meet the documents in a join that needs no second shuffle.

Defined results: null text has size 0; a source of size 0 has target 0; the null source
is a source like others, last in order; repeated rows are separate rows (equal rows may
swap places); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.store import written

#: Weights of sources in code point order, repeating; how often a source may be used; sections of a source at most; documents of a shard.
WEIGHTS, MOST, SECTIONS, SHARD_DOCS = (5, 2, 1), 3, 1024, 400
#: Words of a block at most, and blocks that the smallest target has at least.
BLOCK, LEAST_BLOCKS, SEED = 512, 200, 17


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the whole by weight; none above most times its size, the excess shared anew by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        by = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / by > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / by
            break
        for i in full:
            out[i] = float(most * sizes[i])
        # Summed anew each time, in order, so that reruns agree to the last bit.
        free -= set(full)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def seats(votes: np.ndarray, n: int, most: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Laguë: n seats to the highest quotients votes / (2 seats + 1); ties to the earlier; most caps each.

    A common divisor is found by bisection, then the last few seats go one by one.
    """
    votes = np.asarray(votes, dtype=float)
    most = np.full(len(votes), np.inf) if most is None else np.asarray(most, dtype=float)
    most = np.where(votes > 0, most, 0)
    n = int(min(n, most.sum()))
    if n <= 0 or not len(votes):
        return np.zeros(len(votes), dtype=np.int64)
    if (votes > 0).sum() == 1:
        return np.where(votes > 0, n, 0).astype(np.int64)
    given = lambda d: np.minimum(np.ceil(votes / d - 0.5).clip(0), most)  # noqa: E731  seats whose quotient is above d * 2
    low, high = votes[votes > 0].min() / (4.0 * n + 4), 4.0 * votes.max()
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if given(mid).sum() > n else (low, mid)
    out = given(high).astype(np.int64)
    # By now seats are left only for quotients that are as good as equal.
    ahead = [(-votes[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(out < most).tolist()]
    heapq.heapify(ahead)
    for _ in range(n - int(out.sum())):
        _, i = heapq.heappop(ahead)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(ahead, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _drawn(source: str | None, shard: int, blocks: int, seed: int) -> int:
    """The block at which a shard's seeded run of blocks begins."""
    return int(np.random.default_rng([seed, zlib.crc32(repr(source).encode()), shard]).integers(blocks))


def shares(have: np.ndarray, n: int, target: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each part of a line of words, and how many of them it gives: n in all by Sainte-Laguë, then evened out until the words come nearest to the target."""
    blocks = np.maximum(1, np.rint(have / block)).astype(np.int64)
    quota = seats(have, n, MOST * blocks)
    # Blocks of a part are equal but not all of the nominal size; the next quotients even out what that has shifted.
    each = have / blocks
    gap = target - float((quota * each).sum())
    for _ in range(len(have)):
        step = 1 if gap > 0 else -1
        open_ = (quota < MOST * blocks) & (have > 0) if step > 0 else quota > 0
        if abs(gap) < block / 2 or not open_.any():
            break
        quotient = have / (2 * quota + step)
        i = int(np.argmax(np.where(open_, quotient, -np.inf)) if step > 0 else np.argmin(np.where(open_, quotient, np.inf)))
        if abs(gap - step * each[i]) >= abs(gap):
            break
        quota[i] += step
        gap -= step * each[i]
    return blocks, quota


def quotas(rows: list[tuple[str | None, int, int]]) -> list[tuple]:
    """From (source, section, size) to (source, section, source_size, target, block, words): what the sections give, in words."""
    of = defaultdict(list)
    for source, section, size in rows:
        of[source].append((section, size))
    names = sorted(of, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n in of[s]) for s in names]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    positive = [t for t in goal if t > 0]
    block = max(1, min(BLOCK, int(min(positive) // LEAST_BLOCKS))) if positive else 1
    number = seats(np.array(goal), round(sum(goal) / block), np.array([MOST * s / block for s in sizes]).round())
    out = []
    for s, size, target, n in zip(names, sizes, goal, number, strict=True):
        parts = sorted(of[s])
        have = np.array([x for _, x in parts], dtype=np.int64)
        blocks, quota = shares(have, int(n), target, block)
        out += [(s, section, size, target, block, float(q * x / k)) for (section, x), k, q in zip(parts, blocks.tolist(), quota.tolist(), strict=True)]
    return out


def drawn(source: str | None, shards: list[int], sizes: list[int], words: float, block: int, seed: int = SEED) -> list[tuple]:
    """Of the shards of a section: (laps, begin, end). laps: how often the whole shard is taken; [begin, end) is the run of words taken once more, which may pass the shard's end."""
    blocks, quota = shares(np.array(sizes, dtype=np.int64), round(words / block), words, block)
    out = []
    for shard, x, k, q in zip(shards, sizes, blocks.tolist(), quota.tolist(), strict=True):
        laps, rest = divmod(q, k)
        first = _drawn(source, shard, k, seed)
        out.append((laps, first * x // k, (first + rest) * x // k if first + rest <= k else x + (first + rest - k) * x // k))
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, prefix: str = "") -> DataFrame:
    """docs with size, source_size, target, taken (words, repeats counted) and copies (whole documents nearest to that), in place of columns of these names; a prefix keeps those."""
    spark = docs.sparkSession
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    words = F.coalesce(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))
    size = F.when(F.col(text).isNull(), 0).otherwise(words).cast("long")
    place = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(source).cast("string"), F.col(text).cast("string"))
    base = docs.select(*own, F.col(source).cast("string").alias("s"), size.alias("n"), place.alias("place"))
    # The null source has a key like others, so that joins and windows share one partitioning.
    sk = F.coalesce(F.concat(F.lit("+"), "s"), F.lit(""))
    shards = F.ceil(F.count("*") / F.lit(SHARD_DOCS)).cast("long")
    counts = written(docs.groupBy(F.col(source).cast("string").alias("s")).agg(shards.alias("shards")).select(sk.alias("sk"), "shards"))
    base = base.withColumn("sk", sk).join(counts, "sk").withColumn("shard", F.pmod(F.xxhash64("place"), F.col("shards")))
    section = F.pmod("shard", F.least("shards", F.lit(SECTIONS).cast("long"))).alias("section")
    lines = written(base.groupBy("sk", "s", section, "shard").agg(F.sum("n").alias("line")))
    found = [(r["s"], r["section"], r["n"]) for r in lines.groupBy("s", "section").agg(F.sum("line").alias("n")).collect()]
    quota = spark.createDataFrame(quotas(found), "qs string, qsection long, source_size long, target double, block long, words double")
    asked = lines.join(quota, lines.s.eqNullSafe(quota.qs) & (lines.section == quota.qsection)).select("sk", "s", "section", "shard", "line", "source_size", "target", "block", "words")

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("shard")
        first = {c: found.column(c)[0].as_py() for c in ("s", "block", "words")}
        runs = drawn(first["s"], found.column("shard").to_pylist(), found.column("line").to_pylist(), first["words"], first["block"], seed)
        out = found.select(["sk", "shard", "source_size", "target", "line"])
        for name, values in zip(("laps", "a", "b"), zip(*runs, strict=True), strict=True):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    given = written(asked.groupBy("sk", "section").applyInArrow(run, "sk string, shard long, source_size long, target double, line long, laps long, a long, b long"))
    order = Window.partitionBy("sk", "shard").orderBy("place", f"c{docs.columns.index(key)}", "n")
    with_line = base.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = with_line.join(given, ["sk", "shard"])
    begin = F.col("end") - F.col("n")

    def shared(lo, hi):
        return F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(begin, lo))

    taken = F.col("laps") * F.col("n") + shared(F.col("a"), F.col("b")) + shared(F.col("a") - F.col("line"), F.col("b") - F.col("line"))
    middle = begin + F.floor(F.col("n") / 2)
    inside = ((middle >= F.col("a")) & (middle < F.col("b"))) | ((middle + F.col("line") >= F.col("a")) & (middle + F.col("line") < F.col("b")))
    copies = F.when(F.col("n") == 0, 0).otherwise(F.col("laps") + inside.cast("int"))
    found = {"size": F.col("n"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("long"), "copies": copies.cast("int")}
    found = {f"{prefix}{c}": x for c, x in found.items()}
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in found], *[x.alias(c) for c, x in found.items()])
