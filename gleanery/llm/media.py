"""Media columns: payloads stored as lossless WebP files, read back as pixel arrays.

A payload (here a text's UTF-8 bytes, filled up with bytes 255 to a multiple of 576) is cut into frames of
4,608 bytes, each a lossless image of its own, so that a long one is many short streams, which are decoded
beside each other; a file with several frames tiles them down one canvas. Files are stored in a
column of a table, and read from that table.

A payload's form follows its bytes, so equal payloads give equal files. Every form has the predictor transform, back-references, a
colour cache and an entropy image (`gleanery.llm.webp` finds tiles' predictors, multipliers and groups of codes):

- coloured: four bytes are a pixel, with the subtract-green and cross-colour transforms, too;
- grey: a byte is a pixel, with the same, for payloads of one unit, which have too few bytes for codes of four channels;
- indexed: a byte is a pixel of a palette (which takes the place of what the colours say about each other), for payloads of 16 or fewer values.

The feature of a payload is the size of its canvas and 64 bits, one for each of 64 equal pieces of its
samples: whether the piece's mean is the whole's or more.

Defined results: a null text is an empty one, whose payload is 576 bytes; rows that share a key each get a row of their
own; bytes that aren't valid UTF-8 are stored as they are (but 255s at the very end of such a text count as filling). Other columns are
never read. Work and memory of a task go by frames: at most READ bytes of payload are in work, beside one row's own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import webp
from gleanery.llm.store import dropped, sized, written

#: Payloads are a multiple of UNIT bytes, filled up with FILL; a frame has FRAME of them; WIDE pixels a row of one byte each or WIDE / 2 of four.
UNIT, FILL, FRAME, WIDE = 576, b"\xff", 8 * 576, 96
#: Payloads of so few values have a palette.
FEW = 16
#: Payload bytes that a task writes and reads at once. Writing takes more memory a byte; reading costs a step for each symbol of the longest stream, so it gains by more streams at once.
BYTES, READ = 3 << 20, 8 << 20
GREY = COLOURED = webp.Form((webp.PREDICT, webp.GREEN, webp.CROSS), cache=6, tiles=4, transform_tiles=5)
INDEXED = webp.Form((webp.PALETTE, webp.PREDICT), cache=4, tiles=4, transform_tiles=5)


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + FILL * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def form_of(data: bytes) -> str:
    if np.count_nonzero(np.bincount(np.frombuffer(data, np.uint8), minlength=256)) <= FEW:
        return "indexed"
    return "grey" if len(data) <= UNIT else "coloured"


def frames(data: bytes) -> Iterator[tuple[webp.Image, webp.Form]]:
    """The images of a payload and how they are written."""
    name = form_of(data)
    for i in range(0, len(data), FRAME):
        part = data[i : i + FRAME]
        if name == "coloured":
            yield webp.Image(WIDE // 2, len(part) // (2 * WIDE), np.frombuffer(part, "<u4")), COLOURED
            continue
        yield webp.Image(WIDE, len(part) // WIDE, np.uint32(webp.OPAQUE) | np.frombuffer(part, np.uint8) * np.uint32(0x010101)), INDEXED if name == "indexed" else GREY


def samples(images: list[webp.Image]) -> bytes:
    """The payload of a file's images: bytes of coloured pixels, or one channel of grey ones."""
    pixels = np.concatenate([im.pixels for im in images])
    return pixels.astype("<u4").tobytes() if images[0].width == WIDE // 2 else (pixels & 255).astype(np.uint8).tobytes()


def _bounded(sizes: list[int], most: int = BYTES) -> Iterator[tuple[int, int]]:
    """Slices of rows (given by their sizes) of about equal size, which hold up to about `most`, one row at least."""
    share, start, held = sum(sizes) / max(1, -(-sum(sizes) // most)), 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n / 2 > share:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _in_parts(items: list, sizes: list[int], work, most: int = BYTES) -> list:
    """work over slices of items."""
    return [x for i, j in _bounded(sizes, most) for x in work(items[i:j])]


def files(payloads: list[bytes]) -> list[bytes]:
    """WebP files of payloads. The frames of one long payload are written in parts, too."""
    every = [(i, im, form) for i, data in enumerate(payloads) for im, form in frames(data)]
    streams = _in_parts(every, [4 * len(im.pixels) if im.width < WIDE else len(im.pixels) for _, im, _ in every], lambda some: webp.encoded([im for _, im, _ in some], [form for _, _, form in some]))
    of: list[list] = [[] for _ in payloads]
    for (i, im, _), stream in zip(every, streams, strict=True):
        of[i].append((stream, (im.width, im.height)))
    return [webp.file_of([s for s, _ in one], [size for _, size in one]) for one in of]


def images(media: list[bytes]) -> list[list[webp.Image]]:
    """The frames of WebP files as pixel arrays."""
    streams = [(i, stream) for i, data in enumerate(media) for stream in webp.frames_of(data)]
    # A text takes about twice the bytes of its file.
    found = _in_parts([s for _, s in streams], [2 * len(s) for _, s in streams], webp.decoded, READ)
    of: list[list] = [[] for _ in media]
    for (i, _), im in zip(streams, found, strict=True):
        of[i].append(im)
    return of


def feature(size: tuple[int, int], data: bytes) -> str:
    pieces = np.frombuffer(data, np.uint8).reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(pieces * 64 >= pieces.sum()).tobytes().hex()
    return f"{size[0]}x{size[1]}:{bits}"


def _sizes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together while the column holds up to `most` bytes: Spark hands over so many rows, however short they are."""
    held, size = [], 0
    for batch in batches:
        n = sum(_sizes(batch.column(column)))
        if held and size + n > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: the WebP file of each row's text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j in _bounded(_sizes(batch.column("text")), 4 * BYTES):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(files([payload(x) for x in part.column("text").to_pylist()]), pa.binary())], names=[key, "media"])

    return rows.mapInArrow(run, f"`{key}` {kind}, media binary")


def read(table: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, width and height of each file's canvas, and its pixels: red, green, blue and alpha, row by row."""
    return _read(table, key, media, "width int, height int, pixels binary", lambda media, found: (*canvas(found), webp.channels_of(found)))


def canvas(found: list[webp.Image]) -> tuple[int, int]:
    return max(im.width for im in found), sum(im.height for im in found)


def _digest(media: bytes, found: list[webp.Image]) -> tuple:
    data = samples(found)
    return len(data.rstrip(FILL)), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(canvas(found), data)


def features(table: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Per file: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, of what its pixels say."""
    return _read(table, key, media, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", _digest)


def _read(table: DataFrame, key: str, media: str, columns: str, use) -> DataFrame:
    rows = table.select(F.col(key).alias("k"), F.col(media).alias("media"))
    kind = rows.schema["k"].dataType.simpleString()
    names, kinds = zip(*(c.split(" ") for c in columns.split(", ")), strict=True)
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]

    def run(batches):
        for batch in _gathered(batches, "media", READ // 2):
            for i, j in _bounded(_sizes(batch.column("media")), READ):
                part = batch.slice(i, j - i)
                data = part.column("media").to_pylist()
                found = [use(m, im) for m, im in zip(data, images(data), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names=[key, *names])

    return rows.mapInArrow(run, f"`{key}` {kind}, {columns}")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """features() of docs' texts, stored in a table and read from it."""
    sized(docs.sparkSession)
    media = written(stored(docs, key, text))
    out = written(features(media, key))
    dropped(media)
    return out
