"""Secret scans with structural confirmation.

Three base patterns (assignments, access keys, hex runs) report spans as they stand.
Further candidates, base64 and hex runs (with colons too), are decoded and reported only
when what they decode to has the structure of a key: DER sequences whose nested lengths add
up, SSH key blobs, or the header of a signed token. PEM blocks are confirmed through their
body. A key may begin after a separator inside a run, and a DER key may go on over lines.
A run is only decoded where a look at its first bytes and lengths fits.

Works on whole texts. Defined results: a null or empty text has no spans; repeated rows
give equal results; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ with the short runs dropped
NEAR = re.compile(r"(?:pass|secret|token|api)", re.I | re.A)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*?)(PRIVATE KEY|PUBLIC KEY|CERTIFICATE)-----([A-Za-z0-9+/=\s\\]*?)-----END \1\2-----")
#: Three dotted runs. The next may begin with this one's second, so what follows the header is only looked at.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.(?=([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
#: Where in a run a token's header may begin after a separator: the first characters of a JSON object.
HEADER = re.compile(r"(?<=[_-])(?=e[yw][A-Za-z0-9_-]{8})")
#: A private key encrypted the traditional way: two header lines, then whole cipher blocks.
LOCKED = re.compile(r"-----BEGIN ([A-Z0-9 ]*?)PRIVATE KEY-----\s+Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,}\s+([A-Za-z0-9+/=\s\\]*?)-----END \1PRIVATE KEY-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Where in a run a key may begin after a separator: the first bytes of a DER sequence, of an SSH blob or of a private SSH container.
INNER = re.compile(r"(?<=[/_-])(?=M[A-P]|AAAA[B-J]|b3Bl)")
#: Characters of the shortest token SIGNED finds.
SHORTEST = 13
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:\s{0,80}){31,}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
#: A line of base64 that goes on another one, as keys are wrapped.
NEXT_LINE = re.compile(r"\r?\n[ \t]{0,80}([A-Za-z0-9+/_-]+={0,2})")
#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "pem", "signed", "der", "ssh")


def decoded(run: str) -> bytes | None:
    """What a run of base64 characters, plain or URL-safe, with or without padding, stands for."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the item at a place, if its length fits."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n == 0x80 or n > 0x84:
        return None
    if n > 0x80:
        width = n & 0x7F
        if at + width > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_key(data: bytes) -> bool:
    """Whether these bytes are one DER sequence of a key or certificate, with all nested lengths in order."""
    top = der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    todo, tags = [(top[1], top[2], 0)], []
    while todo:
        at, end, depth = todo.pop()
        while at < end:
            item = der_item(data, at, end)
            if not item:
                return False
            if depth == 0:
                tags.append(item[0])
            if item[0] & 0x20:
                todo.append((item[1], item[2], depth + 1))
            at = item[2]
    return tags[:2] in ([0x02, 0x02], [0x02, 0x30], [0x30, 0x03], [0x30, 0x30], [0x30, 0x04], [0x02, 0x04]) and len(data) >= 24


def ssh_key(data: bytes) -> bool:
    """Whether these bytes are an SSH key: the private container, or a public blob whose string lengths add up."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, parts = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data) or len(data) < at + 4:
            return False
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return len(parts) >= 2 and re.match(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-[a-z0-9-]+|sk-[a-z0-9@.-]+)$", parts[0]) is not None


def peek(run: str, start: int, at: int, n: int) -> bytes:
    """Bytes at to at + n of what a run decodes to from its character start on, without decoding the rest; fewer at its end."""
    first = start + at // 3 * 4
    found = decoded(run[first : first + (at % 3 + n + 2) // 3 * 4].rstrip("="))
    return (found or b"")[at % 3 : at % 3 + n]


def der_size(head: bytes) -> int | None:
    """Length of the DER sequence that begins with these bytes, header included."""
    top = der_item(head + bytes(8), 0, 1 << 40) if head[:1] == b"0" and len(head) > 5 else None
    return None if top is None else top[2]


def begins_key(run: str, start: int = 0) -> bool:
    """Whether what a run decodes to from a character on has the outer lengths of a key, as far as these can be read without decoding it all."""
    size = (len(run) - start) * 3 // 4
    head = peek(run, start, 0, 48)
    if head.startswith(b"openssh-key-v1\0"):
        return True
    if head[:1] == b"0":
        return der_size(head) == size
    if not re.match(rb"\0\0\0.(ssh-|ecdsa-|sk-)", head, re.S):
        return False
    at = 0
    while at < size:
        length = peek(run, start, at, 4)
        at += 4 + int.from_bytes(length, "big")
        if len(length) < 4:
            return False
    return at == size


def key_kind(data: bytes | None) -> int | None:
    """The place in KINDS of the key that these bytes are."""
    return None if data is None else 5 if der_key(data) else 6 if ssh_key(data) else None


def inner_key(run: str) -> tuple[int, int] | None:
    """Offset and kind of a key that begins after a separator inside a run."""
    body = run.rstrip("=")
    for m in INNER.finditer(body):
        if len(body) - m.start() < 40:
            return None
        if begins_key(body, m.start()) and (kind := key_kind(decoded(body[m.start() :]))) is not None:
            return m.start(), kind
    return None


def wrapped_key(text: str, start: int, end: int) -> int | None:
    """Where a DER key ends that begins at a run and goes on over the next lines; its outer length says how much belongs to it."""
    size = der_size(peek(text[start:end], 0, 0, 8))
    if size is None:
        return None
    want, parts, held = -(-size * 4 // 3), [text[start:end]], end - start
    while held < want:
        m = NEXT_LINE.match(text, end)
        if not m or parts[-1].endswith("="):
            return None
        parts.append(m[1])
        held, end = held + len(m[1]), m.end()
    body = "".join(parts)
    extra = len(body.rstrip("=")) - want
    return end if extra == 0 and len(parts) > 1 and der_key(decoded(body) or b"") else None


def signed_header(run: str) -> bool:
    """Whether a run decodes to the header of a signed token: a JSON object that names its algorithm."""
    data = decoded(run)
    try:
        head = json.loads(data) if data and data[:1] == b"{" else None
    except (ValueError, RecursionError):  # what nests without end is no header
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the signed tokens in a text. A header begins where its run does or behind a separator in it."""
    found, end = [], 0
    for m in SIGNED.finditer(text):
        for start in (m.start(), *(m.start() + h.start() for h in HEADER.finditer(m[1]))):
            run = text[start : m.end(1)]
            if start >= end and peek(run, 0, 0, 1) == b"{" and signed_header(run):
                end = m.end(3)
                found.append((start, end))
                break
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns; kind is a place in KINDS."""
    found = []
    if NEAR.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if any(len(w) >= 24 for w in text.split()):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that decode to a key, an SSH blob or a signed token."""
    found, taken = [], []  # taken: spans that hold no further candidates, by start
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if key_kind(decoded(re.sub(r"\\n|\\r|\s", "", m[3]))) is not None:
                found.append((m.start(), 3, m.end()))
                taken.append((m.start(), m.end()))
        for m in LOCKED.finditer(text):
            blocks = decoded(re.sub(r"\\n|\\r|\s", "", m[2]))
            if blocks and len(blocks) % 8 == 0 and len(blocks) >= 32:
                found.append((m.start(), 3, m.end()))
                taken.append((m.start(), m.end()))
        taken.sort()
    words = [w for w in text.split() if len(w) >= SHORTEST]
    if any(w.count(".") >= 2 for w in words):
        tokens = signed_tokens(text)
        found += [(a, 4, b) for a, b in tokens]
        taken = sorted(taken + tokens)
    if any(w.count(":") >= 31 for w in words) or text.count(":") >= 31 and COLONS.search(text):
        found += [(m.start(), kind, m.end()) for m in COLONS.finditer(text) if (kind := key_kind(bytes.fromhex(re.sub(r"[:\s]", "", m[0])))) is not None]
    if all(len(w) < 40 for w in words):
        return found
    for pattern in (BASE64, HEX_KEY):
        place = 0
        for m in pattern.finditer(text):
            i = bisect.bisect_right(taken, (m.start(), len(text) + 1)) - 1
            if m.start() < place or i >= 0 and taken[i][1] > m.start():
                continue
            if pattern is HEX_KEY:
                if m[0][:2] == "30" and (kind := key_kind(bytes.fromhex(m[0]))) is not None or m[0][:6] == "000000" and (kind := key_kind(bytes.fromhex(m[0]))) is not None:
                    found.append((m.start(), kind, m.end()))
            elif begins_key(m[0].rstrip("=")) and (kind := key_kind(decoded(m[0]))) is not None:
                found.append((m.start(), kind, m.end()))
            elif end := wrapped_key(text, m.start(), m.end()):
                found.append((m.start(), 5, end))
                place = end
            elif inner := inner_key(m[0]):
                found.append((m.start() + inner[0], inner[1], m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256 and spans (all, as kind:start:end)."""
    names = ("n_assign", "n_access", "n_hex")
    schema = T.StructType([df.schema[key], *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for batch in batches:
            counts, digest, spans = ([], [], []), [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + confirmed_spans(t)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, schema)
