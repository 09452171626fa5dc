"""BPE encoding and decoding by batched merge rounds.

Words of a batch that are not yet known are cut into symbols which lie in one flat
array. Each round finds the lowest-ranked adjacent pair of every word and merges it;
ranks come from a binary search over the sorted keys of all mergeable pairs. Known
words keep their ids in a bounded table, so a round only sees new words.

Results equal those of the tokenizers library for vocabularies of the kind "BPE with
word ends": NFC, lower case, white space dropped, bytes as symbols.

Defined results: a null or empty text has no ids and decodes to the empty text; ids
that the vocabulary lacks are skipped by decoding; repeated rows give equal results;
columns other than those named are kept by encode() and decode() and never read.
Python's case table (Unicode 15.1) lacks 55 capital letters of Unicode 16, which stay
capitals here.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the vocabulary's splitting rule (the Unicode property, without U+001C to U+001F).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

FAST = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


# Letters and digits of Unicode 16, which the vocabulary's library knows and Python's table (15.1) doesn't yet.
UNICODE_16 = (
    "1C89-1C8A A7CB-A7CE A7D2-A7D2 A7D4-A7D4 A7DA-A7DC 105C0-105F3 10D40-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 "
    "116D0-116E3 11BC0-11BE0 11BF0-11BF9 13460-143FA 16100-1611D 16130-16139 16D40-16D6C 16D70-16D79 16EA0-16EB8 18CFF-18CFF 1CCF0-1CCF9 1E5D0-1E5ED 1E5F0-1E5FA"
)


def late_characters() -> str:
    """Letters and digits newer than Unicode 16, as ranges of a set. For the vocabulary they are signs."""
    known = {c for a, b in (r.split("-") for r in UNICODE_16.split()) for c in range(int(a, 16), int(b, 16) + 1)}
    unassigned = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)] if c not in known and unicodedata.category(chr(c)) == "Cn")
    runs: list[list[int]] = []
    for c in map(ord, regex.findall(r"[\p{L}\p{N}]", unassigned)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs) or r"\U0010ffff"


LATE = late_characters()
FIRST_LATE = chr(int(LATE[2:10], 16))
HAS_LATE = regex.compile(f"[{LATE}]")
SLOW = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{LATE}]]+|[\p{{N}}--[{LATE}]]|(?:[^{SPACE}\p{{L}}\p{{N}}]|[{LATE}])+")


def split_words(text: str) -> list[str]:
    """The words of a text as the vocabulary parts them."""
    text = lowered(text)
    late = not text.isascii() and max(text) >= FIRST_LATE and HAS_LATE.search(text)
    return (SLOW if late else FAST).findall(text)
NONE = np.int32(2**31 - 1)
#: Words kept in a worker's table before it starts anew, and characters of text per batch.
MOST_WORDS, BATCH_CHARS = 400_000, 3_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Vocabulary:
    """A vocabulary file, its merges as sorted arrays, and the table of words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = 1 + max([*ids.values(), *self.special.values()])
        self.text = [""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.text[i] = token
        self.inner = np.array([ids[c] for c in byte_symbols()], dtype=np.int32)
        self.last = np.array([ids[c + self.end] for c in byte_symbols()], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        self.size = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, 0).astype(np.int32)
        used = np.full(size, NONE, dtype=np.int32)  # lowest rank of a merge that takes the symbol
        for side in (left, right):
            np.minimum.at(used, side, np.arange(len(pairs), dtype=np.int32))
        # Where a merge makes only pairs of higher rank, all its places in a word may be merged in one round.
        self.together = used[self.made] > np.arange(len(pairs))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.begin, self.length, self.filled = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64), 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_rank[at], NONE)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        raw = [w.encode() for w in words]
        count = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(count)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), count)
        rank = np.full(len(sym), NONE, dtype=np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(sym[:-1], sym[1:]), NONE)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            live = np.repeat(least < NONE, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                keep = least < NONE
                sym, word, rank, sizes, least = sym[live], word[live], rank[live], sizes[keep], least[keep]
                if not len(sym):
                    break
            lowest = np.repeat(least, sizes)
            at = np.flatnonzero(rank == lowest)
            # Of places that overlap (a pair of equal symbols in a run) every second one is merged, from the left.
            fresh = np.r_[True, np.diff(at) != 1]
            run = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            single = ~self.together[rank[at]]
            if single.any():
                new_word = np.r_[True, word[at][1:] != word[at][:-1]]
                at = at[new_word | ~single]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, at = sym[keep], word[keep], rank[keep], place[at]
            todo = np.unique(np.r_[at, at[at > 0] - 1])
            rank[todo] = NONE
            todo = todo[todo + 1 < len(sym)]
            todo = todo[word[todo] == word[todo + 1]]
            rank[todo] = self.ranks(sym[todo], sym[todo + 1])
        sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(raw))

    def learn(self, words: list[str]) -> None:
        ids, count = self.merged(words)
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.note(words, self.filled + np.cumsum(count) - count, count)
        self.filled += len(ids)

    def note(self, words: list, begin, count) -> None:
        """Where the ids of new words lie."""
        n = len(self.known)
        while n + len(words) > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.length))
        self.begin[n : n + len(words)], self.length[n : n + len(words)] = begin, count
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def words(self, text: str) -> list[str | int]:
        """The words of a text; a special token is its id."""
        if self.special_re is None or not self.special_re.search(text):
            return split_words(text)
        out: list[str | int] = []
        begin = 0
        for m in self.special_re.finditer(text):
            out += split_words(text[begin : m.start()])
            out.append(self.special[m[0]])
            begin = m.end()
        return out + split_words(text[begin:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > MOST_WORDS:
            self.forget()
        split = [self.words(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.known) if split else set()
        for w in [w for w in fresh if isinstance(w, int)]:
            fresh.discard(w)
            self.learn_id(w)
        if fresh:
            self.learn(list(fresh))
        find, out = self.known.__getitem__, []
        for words in split:
            if not words:
                out.append(np.empty(0, dtype=np.int32))
                continue
            w = np.fromiter(map(find, words), dtype=np.int64, count=len(words))
            n = self.length[w]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.begin[w] - ends + n, n)])
        return out

    def learn_id(self, i: int) -> None:
        if self.filled == len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.filled] = i
        self.note([i], self.filled, 1)
        self.filled += 1

    def decode(self, ids) -> str:
        """The tokens joined by blanks, as a vocabulary file without a decoder asks for."""
        get, size = self.text.__getitem__, self.size
        return " ".join([get(i) for i in ids if 0 <= i < size and get(i)])


def lowered(text: str) -> str:
    """NFC and lower case of each character by itself, so a final sigma stays an ordinary one."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary of each path for a worker's life."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BATCH_CHARS characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _added(df: DataFrame, field: T.StructField, make) -> DataFrame:
    """df with one more column (or that column anew): make takes an Arrow batch and yields (rows, their values)."""
    names = [c for c in df.columns if c != field.name]
    schema = T.StructType([df.schema[c] for c in names] + [field])

    def run(batches):
        for batch in batches:
            for rows, values in make(batch):
                yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in names], values], names=[*names, field.name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of column text as an array in column out."""

    def make(batch):
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        for a, b in pieces(texts):
            ids = vocabulary(path).encode(texts[a:b])
            offsets = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            yield batch.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return _added(df, T.StructField(out, T.ArrayType(T.IntegerType(), True)), make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the ids in column ids as column out; null ids decode to the empty text."""

    def make(batch):
        yield batch, pa.array([vocabulary(path).decode([i for i in x or [] if i is not None]) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())

    return _added(df, T.StructField(out, T.StringType()), make)


def digests(df: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), ids_too: bool = False) -> DataFrame:
    """Encodes and decodes each text in one pass; returns the columns to carry, n_tokens and the digests of ids and decoded text, and ids if asked."""
    fields = [df.schema[c] for c in carry] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType(), True))] * ids_too)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(carry)).to_pylist()
            for a, b in pieces(texts):
                all_ids = vocabulary(path).encode(texts[a:b])
                found = []
                for ids in all_ids:
                    whole = vocabulary(path).decode(ids.tolist())
                    found.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()))
                n, i, d = zip(*found, strict=True)
                columns = [*[batch.column(c).slice(a, b - a) for c in range(len(carry))], pa.array(n, pa.int64()), pa.array(i), pa.array(d)]
                if ids_too:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(all_ids), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*carry, F.col(text).cast("string")).mapInArrow(run, schema)
