"""Lossless WebP: streams written with every transform read back; hand-made streams; the media columns of documents."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gleanery.llm import media, webp
from gleanery.llm.webp import CROSS, GREEN, OPAQUE, PALETTE, PREDICT, Form, Image

TRANSFORMS = [(), (GREEN,), (PREDICT,), (CROSS,), (PREDICT, CROSS, GREEN), (CROSS, PREDICT, GREEN), (PALETTE,), (PALETTE, PREDICT)]


def pictures(many=72):
    rng = np.random.default_rng(4)
    for k in range(many):
        w, h = int(rng.integers(1, 90)), int(rng.integers(1, 60))
        n, transforms = w * h, TRANSFORMS[k % len(TRANSFORMS)]
        if PALETTE in transforms or k % 5 == 0:
            px = np.uint32(OPAQUE) | rng.integers(0, [2, 3, 10, 200][k // 8 % 4], n, dtype=np.uint32) * np.uint32(0x10101)
        elif k % 5 == 1:
            px = rng.integers(0, 2**32, n, dtype=np.uint32)
        elif k % 5 == 2:
            px = np.resize(rng.integers(0, 2**32, 37, dtype=np.uint32), n)
        elif k % 5 == 3:
            px = np.full(n, rng.integers(0, 2**32), np.uint32)
        else:
            y, x = np.divmod(np.arange(n), w)
            px = OPAQUE | (x * 3 % 256).astype(np.uint32) << 16 | (y * 5 % 256).astype(np.uint32) << 8 | ((x + y) % 256).astype(np.uint32)
        yield Image(w, h, px.astype(np.uint32)), Form(transforms, [0, 1, 6, 11][k % 4], [0, 2, 3][k % 3], 2 + k % 4, [0, 2, 4, 5][k % 4])


def test_every_transform_cache_and_entropy_image_round_trips():
    images, forms = zip(*pictures(), strict=True)
    streams = webp.encoded(list(images), list(forms))
    for a, b, form in zip(images, webp.decoded(streams), forms, strict=True):
        assert (a.width, a.height) == (b.width, b.height) and (a.pixels == b.pixels).all(), form
    # Each alone gives the same as all together.
    assert [webp.encoded([a], [f])[0] for a, f in zip(images[:16], forms, strict=False)] == streams[:16]
    assert all((webp.decoded([s])[0].pixels == a.pixels).all() for s, a in zip(streams[:16], images, strict=False))


def test_repeats_and_gradients_get_small():
    y, x = np.divmod(np.arange(96 * 48), 96)
    repeated = Image(96, 48, np.resize(np.arange(40, dtype=np.uint32) * 977 | OPAQUE, 96 * 48).astype(np.uint32))
    assert len(webp.encoded([repeated], [Form()])[0]) < 400
    flat = Image(96, 48, np.full(96 * 48, OPAQUE | 5, np.uint32))
    assert len(webp.encoded([flat], [Form()])[0]) < 60


def fields(*pairs):
    """A stream written bit by bit, lowest first."""
    value, at = 0, 0
    for v, n in pairs:
        value |= v << at
        at += n
    return value.to_bytes((at + 7) // 8, "little")


HEAD = lambda w, h: [(0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3)]
ONE = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]


def test_streams_put_together_by_hand():
    # Two symbols for green (10: bit 0, 20: bit 1), one for the others: 2 x 2 pixels.
    two = [(1, 1), (1, 1), (1, 1), (10, 8), (20, 8)]
    plain = fields(*HEAD(2, 2), (0, 1), (0, 1), (0, 1), *two, *ONE(1), *ONE(2), *ONE(255), *ONE(0), (0, 1), (1, 1), (1, 1), (0, 1))
    assert [f"{p:08x}" for p in webp.decoded([plain])[0].pixels] == ["ff010a02", "ff011402", "ff011402", "ff010a02"]
    # Subtract green: 10 is added to red 1 and blue 2.
    green = fields(*HEAD(1, 1), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *ONE(10), *ONE(1), *ONE(2), *ONE(255), *ONE(0))
    assert webp.decoded([green])[0].pixels.tolist() == [0xFF0B0A0C]
    # A palette of two colours, eight pixels in one: colour 1 is the sum of both steps; index bits 0, 1, 1, 0, 1.
    steps = [(0, 1), *[(1, 1), (1, 1), (1, 1), (5, 8), (7, 8)], *ONE(3), *ONE(4), *ONE(100), *ONE(0), (0, 1), (1, 1)]
    palette = fields(*HEAD(5, 1), (1, 1), (3, 2), (1, 8), *steps, (0, 1), (0, 1), (0, 1), *ONE(0b10110), *ONE(0), *ONE(0), *ONE(255), *ONE(0))
    assert [f"{p:08x}" for p in webp.decoded([palette])[0].pixels] == [("64030504", "c8060c08")[i] for i in (0, 1, 1, 0, 1)]
    # Predictor 11 over 3 x 2 pixels whose residuals are all 1: the borders follow black, left and upper pixels.
    mode = [(0, 1), *ONE(11), *ONE(0), *ONE(0), *ONE(255), *ONE(0)]
    picked = fields(*HEAD(3, 2), (1, 1), (0, 2), (0, 3), *mode, (0, 1), (0, 1), (0, 1), *ONE(1), *ONE(1), *ONE(1), *ONE(0), *ONE(0))
    assert [f"{p:08x}" for p in webp.decoded([picked])[0].pixels] == ["ff010101", "ff020202", "ff030303", "ff020202", "ff030303", "ff040404"]
    # Cross-colour: green to red 32 (adds green), red to blue -32 (takes the new red away).
    cross = [(0, 1), *ONE(0), *ONE(256 - 32), *ONE(32), *ONE(255), *ONE(0)]
    crossed = fields(*HEAD(1, 1), (1, 1), (1, 2), (0, 3), *cross, (0, 1), (0, 1), (0, 1), *ONE(10), *ONE(1), *ONE(50), *ONE(255), *ONE(0))
    assert webp.decoded([crossed])[0].pixels.tolist() == [0xFF0B0A27]


def test_broken_streams_are_refused():
    images, forms = zip(*pictures(8), strict=True)
    good = webp.encoded(list(images), list(forms))
    rng = random.Random(2)
    for stream in good:
        with pytest.raises(ValueError):
            webp.decoded([stream[: len(stream) // 2]])
        for _ in range(20):
            bad = bytearray(stream)
            for _ in range(3):
                bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
            try:
                webp.decoded([bytes(bad)])
            except ValueError:
                pass
    for bad in (b"", b"RIFF", b"RIFF\x04\0\0\0WEBQ"):
        with pytest.raises(ValueError):
            webp.frames_of(bad)


def payload_of(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


def test_media_of_documents(spark, documents, corpus):
    found = media.digests(documents).collect()
    want = {}
    for k, text, *_ in corpus[0]:
        want.setdefault(k, set()).add((len((text or "").encode()), hashlib.sha256(payload_of(text)).hexdigest(), zlib.crc32(payload_of(text)[-32:])))
    assert len(found) == len(corpus[0])
    assert all((r.n_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id] and r.payload_bytes % 576 == 0 and r.payload_bytes >= r.n_bytes for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())
    assert {media.form_of(payload_of(t)) for _, t, *_ in corpus[0]} == {"grey", "indexed", "coloured"}


def test_pixel_arrays_and_files(spark):
    texts = ["", None, "é" * 300, "abc " * 5000, "".join(chr(33 + i % 90) for i in range(20_000)), "x" * 700_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    files = media.stored(rows)
    raw = {r.doc_id: r.media for r in files.collect()}
    for r in media.read(files).collect():
        data, pixels = payload_of(texts[r.doc_id]), np.frombuffer(r.pixels, np.uint8).reshape(-1, 4)
        assert r.width * r.height == len(pixels)
        if media.form_of(data) == "coloured":
            assert pixels[:, [2, 1, 0, 3]].tobytes() == data
        else:
            assert r.width == 96 and (pixels[:, 3] == 255).all() and all(pixels[:, c].tobytes() == data for c in range(3))
        head = raw[r.doc_id]
        assert head[:4] == b"RIFF" and len(head) == int.from_bytes(head[4:8], "little") + 8 and head[12:16] == (b"VP8L" if len(data) <= media.FRAME else b"VP8X")
    assert media.digests(rows.where("false")).count() == 0
    assert len(raw[5]) < 30_000


def test_every_payload_takes_every_step():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ,.") for _ in range(n)) for n in (40, 500, 577, 4000, 4608, 20_000)] + ["", "ab" * 4000]
    payloads = [payload_of(t) for t in texts]
    assert [media.form_of(p) for p in payloads] == ["grey"] * 2 + ["coloured"] * 4 + ["indexed"] * 2
    for p in payloads:
        for _, form in media.frames(p):
            assert PREDICT in form.transforms and form.cache and form.tiles and form.match
            assert PALETTE in form.transforms or {CROSS, GREEN} <= set(form.transforms)
    assert [media.samples(im) for im in media.images(media.files(payloads))] == payloads


def test_predictors_multipliers_and_groups_are_looked_for():
    rng = np.random.default_rng(8)
    y, x = np.divmod(np.arange(48 * 48), 48)
    # Rows that go on from the one above; a red that follows green by half; noise, in which nothing follows anything.
    down = OPAQUE | (np.cumsum(rng.integers(0, 3, (48, 48)), axis=0).ravel() % 256 << 8).astype(np.uint32)
    green = rng.integers(0, 100, 48 * 48)
    half = OPAQUE | ((green // 2) << 16 | green << 8).astype(np.uint32)
    noise = OPAQUE | rng.integers(97, 123, 48 * 48).astype(np.uint32) << 8
    # Upper rows of one alphabet, lower ones of another.
    two = OPAQUE | (np.where(y < 32, 97, 200) + rng.integers(0, 26, 48 * 48)).astype(np.uint32) << 8
    images = [Image(48, 48, p.astype(np.uint32)) for p in (down, half, noise, two)]
    form = Form((PREDICT, CROSS), 6, 4)
    done = webp._transformed(images, [form] * 4)
    modes, multipliers = ([d[2][k][2] for d in done] for k in (0, 1))
    assert (modes[0] >> 8 & 15 == 2).all() and not (modes[2] >> 8 & 15).any()
    assert (multipliers[1] & 255 == 16).all() and not (multipliers[2] & 0xFFFFFF).any()
    groups = webp._groups([(im.pixels, 48, 48, 4) for im in images])
    assert not groups[2].any() and groups[3].tolist() == [0] * 6 + [1] * 3
    streams = webp.encoded(images, [form] * 4)
    assert all((a.pixels == b.pixels).all() for a, b in zip(images, webp.decoded(streams), strict=True))
    # Without predictors; without multipliers.
    assert len(streams[0]) < len(webp.encoded(images[:1], [Form((CROSS,), 6, 4)])[0]) and len(streams[1]) < len(webp.encoded(images[1:2], [Form((PREDICT,), 6, 4)])[0])
