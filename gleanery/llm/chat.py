"""Chat formatting: transcripts parsed by a hidden Markov model, then rendered in one form.

Each line of a transcript that isn't blank is seen through its speaker marker, if any, and a
few features of form (a question mark at the end, length, a list or code look, a blank line
before). Hidden is the role that speaks (system, user, assistant or another one) and whether
the line begins a turn. Emissions and transitions are counted on a bounded sample of
conversations whose roles are known, other ones than those held out for measuring. The
Viterbi path of a transcript gives its turns, also where markers are missing or a marker word
is only part of what somebody says: a blank line and the order of speakers then tell.

Transcripts may be long. A conversation lies in parts of bounded size, and the path goes over
all of them: each part of a conversation with several gives the best score from any state
before it to any state at its end (one small matrix), these are put together in order, and
each part is then read between the states that the whole conversation's path has at its ends.
So the result is the same as if the conversation had been read at once.

Rendering is canonical: one marker line for each turn, its text, an end mark. Marks that
occur in a text are defused by a blank. There is one row a turn, whatever the length.

Defined results: null and empty transcripts have no turns; a transcript without any marker is
split by the model alone; other roles than the three keep the name that their marker has, or
are called "other". Of rows: a null turn counts as 0; rows of equal turn are in the order of
role and text; a row repeated in conversation, turn, role and text is one turn; each distinct
row with a null conversation is a conversation of its own; extra columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.store import dropped, written

ROLES = ("system", "user", "assistant")
OTHER = "other"
#: States are 2 * role + (0: begins a turn, 1: goes on), the last role being any other one.
STATES = 2 * len(ROLES) + 2
#: Fixed words that name speakers.
NAMES = {"system": "system instruction instructions context", "user": "user human customer question prompter q", "assistant": "assistant ai bot model answer agent gpt a"}
ROLE_OF = {w: i for i, r in enumerate(ROLES) for w in NAMES[r].split()}
#: A name in one of the forms of marker: with signs around it, or plain before a colon.
MARKER = re.compile(r"\s*(?:\#{1,4}\s*([\w-]{1,30})\s*(?::|$)|\*\*([\w-]{1,30})(?:\*\*\s*:|:\*\*)|<\|?([\w-]{1,30})\|?>:?|\[([\w-]{1,30})\]:?|([\w-]{1,30})\s*:(?=\s|$))[ \t]*")
LISTLIKE = re.compile(r"\s*(?:[-*+]\s|\d+[.)]\s|```|\s{4}\S)")
#: Kinds of marker: none, the three roles, another name with signs, another plain one.
NONE, SIGNED, PLAIN = 0, 4, 5
#: Conversations that the model is counted on at most, turn numbers of a part, rows of a part beyond which it is parted further, and what is added to each count.
SAMPLE, PART, CROWD, SMOOTH = 2000, 256, 1024, 0.5
#: What the marker of its own role counts for the first line of a turn before anything is counted.
PRIOR = 3.0
#: Numbers of values of the features of a line, in the order of features().
SIZES = (6, 2, 4, 2, 2)
BEGIN, END = "<|{}|>\n", "\n<|end|>\n"


def split(line: str) -> tuple[int, str, str]:
    """The kind of a line's marker, the name in it and the rest of the line."""
    m = MARKER.match(line)
    if not m:
        return NONE, "", line
    name = (m[1] or m[2] or m[3] or m[4] or m[5]).lower()
    return (1 + ROLE_OF[name] if name in ROLE_OF else PLAIN if m[5] else SIGNED), name, line[m.end() :]


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines that aren't blank, and one row for each of them: marker, question, length, list look, blank line before."""
    places, out, blank = [], [], False
    for i, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        marker, _, rest = split(line)
        rest = rest.strip()
        places.append(i)
        out.append((marker, rest.endswith("?"), min(3, len(rest) // 60), LISTLIKE.match(line) is not None, blank))
        blank = False
    return np.array(places, dtype=np.int64), np.array(out, dtype=np.int64).reshape(-1, len(SIZES))


def counts(seen: np.ndarray, states: np.ndarray) -> np.ndarray:
    """What one transcript counts, as one row: first states, steps, and the values of each feature by state."""
    begin, step, show = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, n)) for n in SIZES]
    if len(states):
        begin[states[0]] += 1
        np.add.at(step, (states[:-1], states[1:]), 1)
        for k, table in enumerate(show):
            np.add.at(table, (states, seen[:, k]), 1)
    return np.concatenate([x.ravel() for x in (begin, step, *show)])


class Hmm:
    def __init__(self, begin: np.ndarray, step: np.ndarray, show: list[np.ndarray]):
        self.begin, self.step, self.show = begin, step, show

    @classmethod
    def counted(cls, total: np.ndarray) -> Hmm:
        """From the sum of counts(). A turn only goes on in its own role."""
        sizes = [STATES, STATES * STATES, *[STATES * n for n in SIZES]]
        begin, step, *show = (x + SMOOTH for x in np.split(np.asarray(total, dtype=float), np.cumsum(sizes)[:-1]))
        step, show = step.reshape(STATES, STATES), [x.reshape(STATES, n) for x, n in zip(show, SIZES, strict=True)]
        for role in range(len(ROLES)):
            show[0][2 * role, 1 + role] += PRIOR
        show[0][STATES - 2, [SIGNED, PLAIN]] += PRIOR
        begin[1::2] = 0
        for s in range(STATES):
            for t in range(1, STATES, 2):
                if t // 2 != s // 2:
                    step[s, t] = 0
        with np.errstate(divide="ignore"):
            return cls(np.log(begin / begin.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(t / t.sum(axis=1, keepdims=True)) for t in show])

    def fit(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.show))

    def states(self, seen: np.ndarray, before: int = -1, after: int = -1) -> np.ndarray:
        """The most likely states (Viterbi), after a state before the first line and with a state at the last one if given; ties go to the earlier state."""
        if not len(seen):
            return np.empty(0, dtype=np.int64)
        fit, back = self.fit(seen), np.zeros((len(seen), STATES), dtype=np.int64)
        score = (self.begin if before < 0 else self.step[before]) + fit[0]
        for i in range(1, len(seen)):
            ways = score[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            score = ways[back[i], np.arange(STATES)] + fit[i]
        path = [int(score.argmax()) if after < 0 else after]
        for i in range(len(seen) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return np.array(path[::-1])

    def across(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best scores of a part: from the start of a transcript to each state at its end, and from each state before it to each at its end."""
        if not len(seen):
            stay = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
            return np.full(STATES, -np.inf), stay
        fit = self.fit(seen)
        ways = np.concatenate([self.begin[None], self.step]) + fit[0]
        for row in fit[1:]:
            ways = (ways[:, :, None] + self.step[None]).max(axis=1) + row
        return ways[0], ways[1:]

    def turns(self, transcript: str | None, before: int = -1, after: int = -1) -> list[tuple[str, str, bool]]:
        """(role, text, whether it goes on from the part before) of each turn."""
        if not transcript:
            return []
        lines, out, last = transcript.split("\n"), [], -1
        places, seen = features(lines)
        for i, state in zip(places.tolist(), self.states(seen, before, after).tolist(), strict=True):
            if state % 2 == 0 or not out:
                _, name, rest = split(lines[i]) if state % 2 == 0 else (NONE, "", lines[i])
                out.append([ROLES[state // 2] if state // 2 < len(ROLES) else name or OTHER, [rest], state % 2 == 1])
            else:
                out[-1][1] += lines[last + 1 : i + 1]
            last = i
        return [(role, "\n".join(text).strip("\n"), on) for role, text, on in out]


def path_over(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """States before and at the end of each part (from Hmm.across) on the best path over all of them; -1 before the first line and where no line was yet."""
    score, back, seen = None, [], False
    for first, ways in parts:
        if not seen:
            seen = bool(np.isfinite(first).any())
            score = first if seen else None
            back.append(np.full(STATES, -1))
        else:
            all_ = score[:, None] + ways
            back.append(all_.argmax(axis=0))
            score = all_.max(axis=0)
    at, out = int(score.argmax()) if seen else -1, []
    for b in reversed(back):
        before = int(b[at]) if at >= 0 else -1
        out.append((before, at))
        at = before
    return out[::-1]


def rendered(role: str, text: str) -> str:
    """The canonical form of a turn. Marks inside texts are defused."""
    return BEGIN.format(role) + text.replace("<|", "< |") + END


#: Forms of markers that transcripts of rows are written with; the last names only the first speaker, and a blank line parts the turns.
FORMS = ("{}: ", "### {}:\n", "<|{}|>\n", "[{}] ", "**{}**: ", "")


def transcripts(rows: DataFrame) -> DataFrame:
    """conv_id, own (a name for conversations without id), at (place of the part), form, roles, texts and transcript, from rows (conv_id, turn, role, text).

    Transcripts are in the manner of logs: each conversation has one form of marker, and turns without a name are parted by a blank line.
    """
    role = F.lower(F.trim("role"))
    rows = rows.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.when(role != "", role).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", F.when(F.col("conv_id").isNull(), F.concat_ws(":", F.xxhash64("turn", "role", "text"), F.xxhash64(F.lit(1), F.col("text"), F.col("role")))))
    rows = rows.withColumn("segment", F.floor(F.col("turn") / PART).cast("long"))
    # Segments with many more rows than numbers are parted by number, and rows of one number by a hash.
    crowds = written(rows.groupBy("conv_id", "segment").agg(F.count("*").alias("m")).where((F.col("m") > CROWD) & F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), F.ceil(F.col("m") / CROWD).alias("buckets")))
    rows = rows.join(crowds, (F.col("conv_id") == F.col("_c")) & (F.col("segment") == F.col("_s")), "left")
    crowded = F.col("buckets").isNotNull()
    at = F.struct("segment", F.when(crowded, F.col("turn")).otherwise(F.lit(0)).alias("number"), F.when(crowded, F.pmod(F.xxhash64("role", "text"), F.col("buckets"))).otherwise(F.lit(0)).cast("long").alias("bucket"))
    # A set, so that what is repeated adds up before the shuffle.
    grouped = rows.select("conv_id", "own", at.alias("at"), F.struct("turn", "role", "text").alias("t")).groupBy("conv_id", "own", "at").agg(F.array_sort(F.collect_set("t")).alias("t"))
    grouped = grouped.withColumn("form", F.pmod(F.xxhash64("conv_id", "own", F.lit(1)), F.lit(len(FORMS))).cast("int"))

    def line(t, i):
        name, form = F.initcap(t["role"]), F.col("form")
        told = F.when(form == 0, F.concat(name, F.lit(": "))).when(form == 1, F.concat(F.lit("### "), name, F.lit(":\n"))).when(form == 2, F.concat(F.lit("<|"), F.lower(name), F.lit("|>\n"))).when(form == 3, F.concat(F.lit("["), F.upper(name), F.lit("] "))).when(form == 4, F.concat(F.lit("**"), name, F.lit("**: "))).when((i == 0) & (F.col("at.segment") == 0), F.concat(name, F.lit(": ")))
        return F.concat(F.coalesce(told, F.lit("\n")), t["text"])

    return grouped.select("conv_id", "own", "at", "form", F.transform("t", lambda t: t["role"]).alias("roles"), F.transform("t", lambda t: t["text"]).alias("texts"), F.array_join(F.transform("t", line), "\n").alias("transcript"))


def labelled(transcript: str, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """features() and states of a transcript's lines, known from the turns it was written from."""
    lines, turn, at = transcript.split("\n"), [], 0
    for k, text in enumerate(texts):
        own = text.split("\n")
        # Markers may stand on a line of their own, and a blank line may part turns.
        while at < len(lines) and not lines[at].endswith(own[0]):
            turn.append(k)
            at += 1
        for _ in own:
            if at < len(lines):
                turn.append(k)
                at += 1
    places, seen = features(lines[: len(turn)])
    turn = np.array(turn)[places]
    role = np.array([ROLES.index(r) if r in ROLES else len(ROLES) for r in roles])
    return seen, 2 * role[turn] + np.r_[0, turn[1:] == turn[:-1]] if len(turn) else turn


def held_out(conv_id):
    """Conversations that the model isn't counted on."""
    return F.pmod(F.xxhash64(conv_id, F.lit(5)), F.lit(4)) == 0


def trained(rows: DataFrame, sample: int = SAMPLE) -> Hmm:
    """The model of a bounded sample of conversations, picked by hash, that have one part and known roles and aren't held out. Only keys are ordered and only counts reach the driver."""
    ends = rows.where(F.col("conv_id").isNotNull() & ~held_out("conv_id")).groupBy("conv_id").agg(F.min(F.coalesce("turn", F.lit(0))).alias("a"), F.max(F.coalesce("turn", F.lit(0))).alias("b"), F.count("*").alias("m"))
    keys = ends.where(f"a >= 0 and b < {PART} and m <= {CROWD}").select(F.col("conv_id").alias("_c"))
    few = F.broadcast(keys.orderBy(F.xxhash64("_c", F.lit(2)), "_c").limit(sample))
    picked = transcripts(rows.join(few, rows.conv_id == F.col("_c"), "left_semi")).where(F.forall("roles", lambda r: r.isNotNull()))

    def run(batches):
        total = 0
        for batch in batches:
            for roles, texts, transcript in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total = total + counts(*labelled(transcript, roles, texts))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["i", "c"])

    summed = {r["i"]: r["c"] for r in picked.select("roles", "texts", "transcript").mapInArrow(run, "i int, c double").groupBy("i").agg(F.sum("c").alias("c")).collect()}
    return Hmm.counted(np.array([summed.get(i, 0.0) for i in range(STATES + STATES**2 + STATES * sum(SIZES))]))


def _ends(parts: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, at, before and after: the states at the ends of the parts (conv_id, at, transcript) of conversations with several."""
    kind = next(f for f in parts.schema.fields if f.name == "conv_id")
    place = parts.schema["at"]
    matrix = T.StructType([kind, place, T.StructField("ways", T.BinaryType())])

    def matrices(batches):
        for batch in batches:
            found = [np.concatenate([x.ravel() for x in model.across(features((t or "").split("\n"))[1])]).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["conv_id", "at", "ways"])

    def joined(table: pa.Table) -> pa.Table:
        at = table.column("at").combine_chunks()
        order = np.lexsort([np.asarray(at.field(n)) for n in ("bucket", "number", "segment")])
        ways = table.column("ways").take(pa.array(order)).to_pylist()
        both = [np.frombuffer(w).reshape(STATES + 1, STATES) for w in ways]
        found = path_over([(b[0], b[1:]) for b in both])
        return pa.table({"conv_id": table.column("conv_id").take(pa.array(order)), "at": at.take(pa.array(order)), "before": pa.array([b for b, _ in found], pa.int32()), "after": pa.array([a for _, a in found], pa.int32())})

    out = T.StructType([kind, place, T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])
    return parts.select("conv_id", "at", "transcript").mapInArrow(matrices, matrix).groupBy("conv_id").applyInArrow(joined, out)


def formatted(rows: DataFrame, model: Hmm | None = None) -> DataFrame:
    """Per turn found: conv_id, segment, number, bucket (the part it is in), place (in the part), role, rendered, goes_on (from the part before), right (as the rows have it at this place) and held_out."""
    made = transcripts(rows)
    model = model or trained(rows)
    long_ = written(rows.where("conv_id is not null").groupBy("conv_id").agg(F.min(F.floor(F.coalesce("turn", F.lit(0)) / PART)).alias("a"), F.max(F.floor(F.coalesce("turn", F.lit(0)) / PART)).alias("b"), F.count("*").alias("m")).where(f"a <> b or m > {CROWD}").select(F.col("conv_id").alias("_c")))
    no_end = F.lit(-1).alias("before"), F.lit(-1).alias("after")
    if long_.isEmpty():
        made = made.select("*", *no_end)
        dropped(long_)
    else:
        ends = written(_ends(made.join(long_, F.col("conv_id") == F.col("_c"), "left_semi"), model)).select(F.col("conv_id").alias("_c"), F.col("at").alias("_at"), "before", "after")
        made = made.join(ends, (F.col("conv_id") == F.col("_c")) & (F.col("at") == F.col("_at")), "left").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("before", "after")})
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", "segment", "number", "bucket", "place", "role", "rendered", "goes_on", "right"]
    types = [kind, T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.BooleanType(), T.BooleanType()]

    def run(batches):
        for batch in batches:
            own, out = [], [[] for _ in range(5)]
            for i, (roles, texts, transcript, before, after) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4, 9)), strict=True)):
                for k, (role, text, on) in enumerate(model.turns(transcript, before, after)):
                    true = k < len(texts) and (roles[k] or OTHER, texts[k].strip("\n")) == (role, text) and not on
                    own.append(i)
                    for column, x in zip(out, (k, role, rendered(role, text), on, true), strict=True):
                        column.append(x)
            first = [batch.column(c).take(pa.array(own, pa.int64())) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*first, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.bool_())], names=names)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    found = made.select("conv_id", "at.segment", "at.number", "at.bucket", "roles", "texts", "transcript", "before", "after").mapInArrow(run, schema)
    return found.withColumn("held_out", F.coalesce(held_out("conv_id"), F.lit(False)))
