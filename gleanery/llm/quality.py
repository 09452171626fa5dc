"""Quality classifier: an interpolated modified Kneser-Ney model of the characters of trusted text.

Trusted are the rows labelled good. The model's units are characters, so there are no
unknown words: every run of ORDER characters of every trusted text that is not held out is
counted, whatever their number. A task counts its own, the shards (hashes of the runs) add
them up. Lower orders hold continuation counts, and joins of each order with the totals of
its histories and with the order below give discounts, back-off weights and probabilities.
The model is a set of tables that grow with the input; it is never in one place.

A document's score is the sum of log p over its characters, so a sum over its distinct runs.
Runs that make up FREQUENT or more of all counts are looked up where the document lies; these
are at most 1 / FREQUENT at any input. Every other run of a document is a row that meets the
sharded tables in joins, first its own order's, then, where it was never seen, the back-off
weights and the orders below. Joins happen once for each distinct run of the corpus; runs in
COMMON or more of the rows (at most 1 / COMMON) reach their rows by a broadcast, the others by
a join in which no key is hot.

A document's perplexity is that of a character. It is rejected where its perplexity lies above
the quantile that trusted documents of its language have; those are held out of the counts,
so they score as new texts do (a language with fewer than LEAST of them, or less than a share
LEAST_SHARE, has the quantile of all languages). The quantile leaves room, more for shorter
texts, so that clean documents stay. A model of other texts can't see that a text repeats
itself, so the perplexity of a document under its own word shares (as its entropy against that
of as many words that are all different) has a lower quantile of its kind beside it.

Defined results: null and empty texts and texts without words have no perplexity and stay; without trusted rows
everything stays; a document labelled twice is trusted if every label says so; repeated rows
get equal results; null languages count as one language; the character NUL counts as the
replacement character; extra columns are kept and never read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gleanery.llm.store import dropped, written

#: Characters of a run, and what stands before a text.
ORDER, START = 4, "\x02"
#: Share of all counts from which on a run is looked up without a join, and share of the rows to be joined from which on a run's score is broadcast.
FREQUENT, COMMON = 5e-7, 2e-5
#: Quantile of trusted documents' perplexities below which documents stay, the room above (as a factor of perplexity), trusted documents a language needs, and their share.
HIGH, ROOM, LEAST, LEAST_SHARE = 0.999, 1.03, 50, 1e-4
#: Quantile of trusted documents' own entropies, and the part of it that a document's own entropy must reach.
LOW, OWN_ROOM = 0.001, 0.8
#: Characters a trusted document needs to take part in quantiles; room in nats for a document of one character, falling with the square root of characters.
SHORT, ROOM_SHORT = 200, 6.0
#: One trusted document of so many is held out of the counts.
HELD = 4
#: Characters that are looked at at once.
PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def cleaned(text: str | None) -> str:
    return (text or "").replace("\0", "�")


def own(text: str) -> float | None:
    """Entropy of a text's word shares, as a part of what as many words that are all different have."""
    count = np.fromiter(Counter(text.split()).values(), dtype=float)
    total = count.sum()
    return None if not total else 1.0 if total == 1 else float(1 - (count * np.log(count)).sum() / total / np.log(total))


def pieces(texts: list[str]):
    """(codes, places, owners): code points of some texts, where runs begin in them, and which text each run is of. Long texts come in parts, so memory is bounded."""
    parts, owners, size = [], [], 0
    for k, text in enumerate(texts):
        padded = START * (ORDER - 1) + text
        for a in range(0, len(text), PIECE):
            part = padded[a : a + PIECE + ORDER - 1]
            if size and size + len(part) > PIECE:
                yield _runs(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(k)
            size += len(part)
    if parts:
        yield _runs(parts, owners)


def _runs(parts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(p) for p in parts])
    runs = sizes - ORDER + 1
    shift = np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(runs) - runs), runs)
    return codes, np.arange(runs.sum()) + shift, np.repeat(np.array(owners), runs)


def keys(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit names of runs."""
    h = np.zeros(len(codes) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        h = (h ^ codes[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h[places]


def strings(codes: np.ndarray, places: np.ndarray) -> list[str]:
    """The runs themselves."""
    window = np.stack([codes[places + k] for k in range(ORDER)], axis=1) if len(places) else np.empty((0, ORDER), np.uint32)
    return np.ascontiguousarray(window).view(f"<U{ORDER}").ravel().tolist()


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney for counts 1, 2 and 3 or more."""
    n = [counts_of_counts.get(i, 0) for i in range(5)]
    if not n[1] or not n[2]:
        return (0.5, 0.75, 0.9)
    y = n[1] / (n[1] + 2 * n[2])
    d1 = 1 - 2 * y * n[2] / n[1]
    d2 = 2 - 3 * y * n[3] / n[2]
    d3 = 3 - 4 * y * n[4] / n[3] if n[3] else d2
    return tuple(min(max(d, 0.1), i + 0.95) for i, d in enumerate((d1, d2, d3)))


def discounted(d: tuple[float, float, float]):
    """The discount of a count, as a column."""
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def trusted(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """lk: keys whose labels all say good."""
    return labels.groupBy(F.col(key).alias("lk")).agg(F.min(F.coalesce(F.col(quality), F.lit(0))).alias("q")).where("q = 1 and lk is not null").select("lk")


def held_out(key):
    """Which trusted documents the model doesn't count: those whose scores give the quantiles, as new texts score."""
    return F.pmod(F.xxhash64(key, F.lit(9)), F.lit(HELD)) == 0


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """g, c: every run of the texts and how often it occurs. A task's table empties itself before it grows large."""

    def run(batches):
        held = {}

        def out():
            found = list(held.items())
            for i in range(0, len(found), 100_000):
                g, c = zip(*found[i : i + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(c, pa.int64())], names=["g", "c"])

        for batch in batches:
            for codes, places, _ in pieces([cleaned(t.as_py()) for t in batch.column(0)]):
                _, first, n = np.unique(keys(codes, places), return_index=True, return_counts=True)
                for g, c in zip(strings(codes, places[first]), n.tolist(), strict=True):
                    held[g] = held.get(g, 0) + c
                if len(held) > 1_000_000:
                    yield from out()
                    held = {}
        yield from out()

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


class Model:
    """Tables by order n: p[n] with g and lp (log p of its last character after the others), weight[n] with h and lw (log of the back-off weight)."""

    def __init__(self, p: dict[int, DataFrame], weight: dict[int, DataFrame], unseen: float, frequent: tuple[np.ndarray, np.ndarray], tables: list[DataFrame]):
        self.p, self.weight, self.unseen, self.frequent, self.tables = p, weight, unseen, frequent, tables

    def valued(self, runs: DataFrame) -> DataFrame:
        """runs (g and more) with v, log p: of the run where it was seen, else by back-off through the orders below."""
        v = F.lit(self.unseen)
        for n in range(1, ORDER + 1):
            lower = v if n == 1 else F.coalesce(F.col(f"lw{n}"), F.lit(0.0)) + v
            v = F.coalesce(F.col(f"lp{n}"), lower)
            tail = F.substring("g", ORDER - n + 1, n)
            table = self.p[n].select(F.col("g").alias("_g"), F.col("lp").alias(f"lp{n}"))
            # One row a character, so Unicode bounds these.
            runs = runs.join(F.broadcast(table) if n == 1 else table, tail == F.col("_g"), "left").drop("_g")
            if n > 1:
                table = self.weight[n].select(F.col("h").alias("_h"), F.col("lw").alias(f"lw{n}"))
                runs = runs.join(F.broadcast(table) if n == 2 else table, F.substring("g", ORDER - n + 1, n - 1) == F.col("_h"), "left").drop("_h")
        made = [f"lp{n}" for n in range(1, ORDER + 1)] + [f"lw{n}" for n in range(2, ORDER + 1)]
        return runs.withColumn("v", v).drop(*made)

    def drop(self) -> None:
        for t in self.tables:
            dropped(t)


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """The model of all trusted texts but those held out; None without any."""
    good = trusted(labels, key).where(~held_out("lk"))
    counts = {ORDER: written(counted(docs.select(key, text).join(good.hint("merge"), F.col(key) == good.lk, "left_semi"), text))}
    for n in range(ORDER - 1, 0, -1):  # in how many ways a run of n characters is preceded
        counts[n] = written(counts[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")))
    tables, p, weight = list(counts.values()), {}, {}
    for n in range(1, ORDER + 1):
        d = discounted(discounts({r["c"]: r["m"] for r in counts[n].where("c <= 4").groupBy("c").agg(F.count("*").alias("m")).collect()}))
        if n == 1:
            all_ = counts[1].agg(F.sum("c").alias("c"), F.sum(d).alias("d"), F.count("*").alias("m")).first()
            if not all_["m"]:
                for t in tables:
                    dropped(t)
                return None
            # A character that no trusted text has takes the place of one more.
            unseen = all_["d"] / all_["c"] / (all_["m"] + 1)
            p[1] = written(counts[1].select("g", F.log((F.col("c") - d) / F.lit(float(all_["c"])) + F.lit(unseen)).alias("lp")))
        else:
            by = counts[n].groupBy(F.substring("g", 1, n - 1).alias("h")).agg(F.sum("c").alias("total"), F.log(F.sum(d) / F.sum("c")).alias("lw"))
            weight[n] = written(by)
            lower = p[n - 1].select(F.col("g").alias("_g"), F.col("lp").alias("_lp"))
            both = counts[n].join(weight[n], F.substring("g", 1, n - 1) == F.col("h")).join(lower, F.substring("g", 2, n - 1) == F.col("_g"))
            p[n] = written(both.select("g", "c", F.log((F.col("c") - d) / F.col("total") + F.exp(F.col("lw") + F.col("_lp"))).alias("lp")))
            tables.append(weight[n])
        tables.append(p[n])
    total = counts[ORDER].agg(F.sum("c")).first()[0]
    often = p[ORDER].where(F.col("c") >= FREQUENT * total).select("g", "lp").toArrow()
    runs = np.frombuffer("".join(often.column("g").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    name = keys(runs, np.arange(0, len(runs), ORDER)) if len(runs) else np.empty(0, np.uint64)
    order = np.argsort(name)
    return Model(p, weight, math.log(unseen), (name[order], np.asarray(often.column("lp"), dtype=float)[order]), tables)


def features(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """Rows of id, g, n, v, own for docs (id, text). A row a text, without g: its characters as n, what needs no join as v. A row for each other run: how often it occurs as n."""
    sent = docs.sparkSession.sparkContext.broadcast(model.frequent)

    def run(batches):
        known, value = sent.value
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), [cleaned(t.as_py()) for t in batch.column(1)]
            sums = np.zeros(len(texts))
            for codes, places, at in pieces(texts):
                f = keys(codes, places)
                place = np.minimum(np.searchsorted(known, f), max(0, len(known) - 1))
                hit = known[place] == f if len(known) else np.zeros(len(f), dtype=bool)
                # In order of the text, so that equal texts add up alike.
                sums += np.bincount(at[hit], weights=value[place[hit]] if len(known) else None, minlength=len(texts))
                f, at, places = f[~hit], at[~hit], places[~hit]
                order = np.lexsort((f, at))
                f, at, places = f[order], at[order], places[order]
                first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (at[1:] != at[:-1])]) if len(f) else np.empty(0, np.int64)
                n = np.diff(np.r_[first, len(f)])
                for i in range(0, len(first), 100_000):
                    some = first[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[some]]), pa.array(strings(codes, places[some]), pa.string()), pa.array(n[i : i + 100_000], pa.int64()), pa.nulls(len(some), pa.float64()), pa.nulls(len(some), pa.float64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums), pa.array([own(t) for t in texts], pa.float64())], names=names)

    names = ["id", "g", "n", "v", "own"]
    return docs.select("id", F.col(text).cast("string")).mapInArrow(run, "id long, g string, n long, v double, own double")


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """id, nll (mean negative log-likelihood of a character), n_chars and own of docs (id, text). Rows of one id count as one."""
    if model is None:  # without a model there is nothing to tell of a text
        return docs.select("id", F.lit(None).cast("double").alias("nll"), F.length(text).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("own")).dropDuplicates(["id"])
    rows = written(features(docs, model, text))
    open_ = rows.where("g is not null").select("id", "g", "n")
    runs = open_.groupBy("g").agg(F.count("*").alias("m"))
    values = written(model.valued(runs))
    all_ = values.agg(F.sum("m")).first()[0] or 0
    near = F.broadcast(values.where(F.col("m") >= COMMON * all_).select("g", F.col("v").alias("near")))
    far = values.where(F.col("m") < COMMON * all_).select("g", F.col("v").alias("far"))
    looked_up = open_.join(near, "g", "left")
    tail = looked_up.where("near is null").drop("near").join(far.hint("merge"), "g").select("id", (F.col("n") * F.col("far")).alias("v"))
    # What a task finds of a document adds up before the shuffle.
    parts = rows.where("g is null").select("id", "v", "n", "own").unionByName(looked_up.where("near is not null").select("id", (F.col("n") * F.col("near")).alias("v")), allowMissingColumns=True)
    parts = parts.groupBy("id").agg(F.sum("v").alias("v"), F.sum("n").alias("all_n"), F.max("n").alias("n"), F.max("own").alias("own")).unionByName(tail.groupBy("id").agg(F.sum("v").alias("v")), allowMissingColumns=True)
    out = parts.groupBy("id").agg(F.sum("v").alias("v"), F.sum("all_n").alias("all_n"), F.max("n").alias("n"), F.max("own").alias("own"))
    scores = written(out.select("id", F.when((F.col("all_n") > 0) & F.col("own").isNotNull(), -F.col("v") / F.col("all_n")).alias("nll"), F.col("n").alias("n_chars"), "own"))
    dropped(rows)
    dropped(values)
    return scores


def room(n_chars):
    """More room for short documents, whose mean varies more."""
    return F.lit(math.log(ROOM)) + F.lit(ROOM_SHORT) / F.sqrt(F.greatest(n_chars, F.lit(1)))


def thresholds(scores: DataFrame) -> tuple[DataFrame, Row]:
    """lang, high, low: quantiles of the trusted scores (lang, nll, own) of each language that has enough; and those of all."""
    cuts = F.percentile_approx("nll", HIGH, 20000).alias("high"), F.percentile_approx("own", LOW, 20000).alias("low"), F.count("*").alias("m")
    every = scores.agg(*cuts).first()
    return scores.groupBy("lang").agg(*cuts).where((F.col("m") >= LEAST) & (F.col("m") >= LEAST_SHARE * every["m"])).select("lang", "high", "low"), every


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", prefix: str = "") -> DataFrame:
    """docs with nll, own, fluent (by perplexity alone) and kept, in place of columns of these names; a prefix keeps those."""
    model = trained(docs, labels, key, text)
    own_id = F.xxhash64(F.col(key), F.col(text)).alias("id")
    scores = scored(docs.select(own_id, text), model, text)
    if model is not None:
        model.drop()
    # Scores meet the labels and the documents by hashes of key and text.
    good = trusted(labels, key).where(held_out("lk"))
    ids = docs.select(key, F.col(lang).cast("string").alias("lang"), own_id).join(good.hint("merge"), F.col(key) == good.lk, "left_semi")
    known = ids.join(scores, "id").where((F.col("n_chars") >= SHORT) & F.col("nll").isNotNull())
    known = written(known.select("lang", "nll", "own"))
    by_lang, every = thresholds(known)
    # A row of every language with LEAST_SHARE or more of the trusted rows: at most 1 / LEAST_SHARE.
    of_lang = F.broadcast(written(by_lang.select(F.col("lang").alias("_lang"), F.col("high").alias("_high"), F.col("low").alias("_low"))))
    dropped(known)
    added = [f"{prefix}{c}" for c in ("nll", "own", "fluent", "kept")]
    names = [c for c in docs.columns if c not in added]
    s = scores.select(F.col("id").alias("_score_id"), F.col("nll").alias("_nll"), F.col("n_chars").alias("_n"), F.col("own").alias("_own"))
    joined = docs.select(*names, F.xxhash64(F.col(key), F.col(text)).alias("_row_id")).join(s, F.col("_row_id") == F.col("_score_id"), "left")
    joined = joined.join(of_lang, F.col(lang).cast("string").eqNullSafe(F.col("_lang")), "left")
    limit = {c: F.coalesce(F.col(f"_{c}"), F.lit(every[c]).cast("double")) for c in ("high", "low")}
    fluent = F.coalesce(F.col("_nll") <= limit["high"] + room(F.col("_n")), F.lit(True))
    kept = fluent & F.coalesce(F.col("_own") >= OWN_ROOM * limit["low"], F.lit(True))
    return joined.select(*names, *[x.alias(c) for c, x in zip(added, (F.col("_nll"), F.col("_own"), fluent, kept), strict=True)])
