"""Line dedup over overlapping three-line windows.

Consecutive lines of a document are hashed three at a time. A window that occurs more
than once anywhere keeps its first occurrence; every later one covers its three lines,
covered lines of overlapping windows merge, and covered lines go.

A line of more than LONG characters is a paragraph, in which a passage can repeat without any
whole line doing so; such lines count as their sentences (up to a full stop, question or
exclamation mark with a blank behind it), so that windows see passages of three sentences there.

"First" is the smallest (doc_id, hash of the text, position), null doc_ids last. Lines are
compared without the blanks at their ends, sentences without such marks there too; a window of
blank lines only counts for nothing. Two 64-bit hashes stand for a window.

A window that makes up COMMON or more of all repeated ones (at most 1 / COMMON are that) meets its
rows in PARTS parts, so no key is hot.

Defined results: texts of fewer than three lines (so counted) stay as they are, null texts
stay null; a document all of whose lines go has the empty text; rows that are equal in key
and text count as one document and all get its result; other columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.store import written

#: Lines of a window, and characters of a line beyond which it counts as its sentences.
SIZE, LONG = 3, 300
#: Share of all repeated windows from which on one is common, and the parts in which its rows are joined.
COMMON, PARTS = 1e-5, 64


def compared(text):
    """Lines of a text as they are compared, long ones as their sentences."""
    return F.flatten(F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(x) > LONG, F.transform(F.split(x, "[.!?] ", -1), lambda y: F.trim(y, F.lit(" .!?")))).otherwise(F.array(F.trim(x)))))


def units(text):
    """The same lines as they stand, each with the line break or blank behind it."""
    return F.flatten(F.transform(F.split(text, r"(?<=\n)", -1), lambda x: F.when(F.length(F.translate(x, "\n", "")) > LONG, F.split(x, r"(?<=[.!?] )", -1)).otherwise(F.array(x))))


def _once(value, use):
    """use(value), with value worked out once for a row: a lambda's body is worked out for each element, and with it all that it names from outside."""
    return F.transform(F.array(value), use)[0]


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h (hash of the text) and at: starts, from 0, of the windows to remove. Only documents that lose lines."""
    names = F.transform(compared(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), (x != "").alias("full")))
    places = lambda ls: F.when(F.size(ls) >= SIZE, F.sequence(F.lit(0), F.size(ls) - SIZE)).otherwise(F.array().cast("array<int>"))

    def window(ls, i):
        three = [F.get(ls, i + j) for j in range(SIZE)]
        full = three[0]["full"] | three[1]["full"] | three[2]["full"]
        return F.when(full, F.struct(F.xxhash64(*[x["a"] for x in three]).alias("w1"), F.xxhash64(*[x["b"] for x in three]).alias("w2")))

    threes = _once(names, lambda ls: F.transform(places(ls), lambda i: window(ls, i)))
    windows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.posexplode(threes).alias("at", "w")).where("w is not null").select("k", "h", "at", "w.w1", "w.w2")
    place = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("h").alias("h"), F.col("at").alias("at"))
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("m")).where(~F.col("first").eqNullSafe(F.col("last"))).select("w1", "w2", "first", "m")
    repeated = written(repeated)
    most = repeated.agg(F.sum("m")).first()[0] or 0
    common = repeated.where(F.col("m") >= COMMON * most)
    parts = F.when(F.col("m") >= COMMON * most, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = repeated.select("w1", "w2", "first", F.explode(parts).alias("part"))
    dealt = windows.join(F.broadcast(common.select("w1", "w2", F.lit(True).alias("hot"))), ["w1", "w2"], "left")
    dealt = dealt.select("k", "h", "at", "w1", "w2", F.when(F.col("hot"), F.pmod(F.xxhash64("h", "at"), F.lit(PARTS))).otherwise(0).cast("int").alias("part"))
    later = dealt.join(firsts, ["w1", "w2", "part"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("k", "h").agg(F.collect_set("at").alias("at"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the repeated lines gone from column text, n_lines, and n_removed (sentences of long lines counted like lines) beside it (in place of columns of these names; a prefix keeps those)."""
    added = (f"{prefix}n_lines", f"{prefix}n_removed")
    gone = covered(docs, key, text)
    d, g = docs.alias("d"), gone.alias("g")
    joined = d.join(g, F.col(f"d.{key}").eqNullSafe(F.col("g.k")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("g.h")), "left")
    lines = units(F.col(f"d.{text}"))
    # The lines that stay are those whose positions are in no window: a difference of sets, so a document costs its length.
    hidden = F.flatten(F.transform("g.at", lambda a: F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda on: a + on)))
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["ls"]) - 1), x["gone"])
    joined_up = lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x["ls"], i)), "")
    # What is behind the last line that stays goes with the last line.
    ended = lambda x: F.when(F.array_contains(x["gone"], F.size(x["ls"]) - 1), F.regexp_replace(joined_up(x), r"[\n ]\z", "")).otherwise(joined_up(x))
    kept = _once(F.struct(lines.alias("ls"), hidden.alias("gone")), ended)
    out = [F.when(F.col("g.at").isNull(), F.col(f"d.{text}")).otherwise(kept).alias(text) if c == text else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in added]
    n = F.coalesce(F.size(F.split(F.col(f"d.{text}"), "\n", -1)), F.lit(0)).cast("long")
    removed = F.when(F.col("g.at").isNull(), 0).otherwise(F.size(F.array_distinct(hidden))).cast("long")
    return joined.select(*out, F.when(F.col(f"d.{text}").isNull(), F.lit(0)).otherwise(n).cast("long").alias(added[0]), removed.alias(added[1]))


#: The same in DuckDB. Windows are compared as text there.
ORACLE_SQL = """
WITH broken AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ps FROM documents
), lines AS (
  SELECT doc_id, text, len(ps) AS n_lines, flatten(list_transform(ps, lambda p: CASE WHEN length(p) > 300 THEN list_transform(regexp_split_to_array(p, '[.!?] '), lambda c: trim(c, ' .!?')) ELSE [trim(p, ' ')] END)) AS cs,
    flatten([CASE WHEN length(ps[i]) > 300 THEN string_split(regexp_replace(ps[i], '([.!?]) ', '\\1 ' || chr(1), 'g') || CASE WHEN i < len(ps) THEN chr(10) ELSE '' END, chr(1)) ELSE [ps[i] || CASE WHEN i < len(ps) THEN chr(10) ELSE '' END] END FOR i IN range(1, len(ps) + 1)]) AS ls FROM broken
), windows AS (
  SELECT doc_id, text, i AS pos, cs[i + 1] || chr(10) || cs[i + 2] || chr(10) || cs[i + 3] AS three
  FROM lines, unnest(range(len(cs) - 2)) AS r(i) WHERE len(cs) >= 3
), firsts AS (
  SELECT three, min(row(doc_id, pos)) AS first FROM windows WHERE length(three) > 2 GROUP BY three HAVING count(*) > 1
), later AS (
  SELECT w.doc_id, list(w.pos) AS pos FROM windows w JOIN firsts f USING (three) WHERE row(w.doc_id, w.pos) <> f.first GROUP BY w.doc_id
), marked AS (
  SELECT l.doc_id, l.text, l.n_lines, l.ls, list_distinct(flatten(list_transform(pos, lambda a: [a, a + 1, a + 2]))) AS gone
  FROM lines l LEFT JOIN later USING (doc_id)
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE regexp_replace(
         coalesce(array_to_string([ls[i + 1] FOR i IN range(len(ls)) IF NOT list_contains(gone, i)], ''), ''), CASE WHEN list_contains(gone, len(ls) - 1) THEN '[\\n ]$' ELSE '$^' END, '') END AS text
FROM marked
"""
