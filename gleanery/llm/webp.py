"""Lossless WebP for many images at once, in numpy.

Reading: headers, code lengths and transform data are parsed image by image; what makes up
nearly all of a stream, its prefix-coded pixels, is decoded for all images in lockstep, one symbol of each
image a step. An image's parser is a generator that hands over a block of coded pixels (its own, or those of a transform) and
gets them back decoded. Prefix codes of five alphabets, entropy images, back-references with
two-dimensional distances and the colour cache are supported; then the predictor, cross-colour,
subtract-green and palette transforms are inverted, the predictor along wave fronts (x + 2y), whose
pixels don't depend on each other (where no tile but the borders looks at a neighbour, no fronts are needed).

Writing: matches come from one sort of hashed runs of pixels, a greedy parse runs in lockstep, and codes are
canonical Huffman codes of at most 11 bits, built in lockstep. Any of the transforms can be asked for. A tile's predictor and
its colour multipliers are those of the fewest bits by the entropy of what they leave; rows of tiles share a group
of codes unless groups of their own are smaller. Several frames make an animated file whose frames tile the canvas.

A stream that breaks the format's rules raises ValueError.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

# Fixed values of the format.
SIGNATURE, LITERALS, LENGTHS, DISTANCES, LONGEST = 0x2F, 256, 24, 40, 15
PREDICT, CROSS, GREEN, PALETTE = 0, 1, 2, 3
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR, OPAQUE = 0x1E35A7BD, 0xFF000000
#: Near places of a back-reference, the nearest first: (columns to the left, rows up).
NEAR = np.array(sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))
#: Extra bits of a length or distance symbol, and the value its extra bits are added to.
EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(DISTANCES)])
BEGIN = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(DISTANCES)])
#: 15-bit numbers with their bits reversed.
REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << LONGEST)])
#: A code for code lengths that serves every image: runs of zeros, and 14 lengths of 4 bits, 4 of 5.
LENGTH_CODE = [5 if s in (1, 13, 14, 15) else 0 if s == 16 else 4 for s in range(19)]


class Bits:
    """A stream's bits, lowest first. begin: its place, in bits, among all streams that are read together."""

    def __init__(self, data: bytes, begin: int = 0):
        self.data, self.at, self.begin = data, 0, begin

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        at, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[at >> 3 : (self.at + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


def _sorted(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """The stable order by keys (values from 0 on, bits they have at most), the first counting most. Keys and places are sorted as one number where that has room."""
    many = len(keys[0][0])
    place = max(1, many.bit_length())
    if sum(bits for _, bits in keys) + place > 63:
        return np.lexsort([values for values, _ in reversed(keys)])
    mixed = np.zeros(many, np.int64)
    for values, bits in keys:
        mixed <<= bits
        mixed |= values
    mixed <<= place
    mixed |= np.arange(many)
    mixed.sort()
    return mixed & ((1 << place) - 1)


def _room(values: np.ndarray) -> int:
    """Bits of the largest value."""
    return int(values.max(initial=0)).bit_length()


class Codes:
    """Canonical prefix codes of many alphabets: flat arrays by code and length, and all symbols by code, length and value."""

    def __init__(self, lengths: list[np.ndarray] | np.ndarray, sizes: np.ndarray | None = None):
        """lengths: those of each alphabet, or of all one after another with the alphabets' sizes."""
        if sizes is None:
            sizes = np.array([len(x) for x in lengths], dtype=np.int64)
            lengths = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        self.offset = np.cumsum(sizes) - sizes
        # Only the symbols that occur are looked at.
        used = np.flatnonzero(lengths)
        flat, at = lengths[used].astype(np.int64), np.searchsorted(used, np.append(self.offset, len(lengths)))
        owner = np.repeat(np.arange(len(sizes)), np.diff(at))
        count = np.bincount(owner * 16 + flat, minlength=16 * len(sizes)).reshape(-1, 16)
        first, limit = np.zeros_like(count), np.zeros_like(count)
        for n in range(1, LONGEST + 1):
            first[:, n] = (first[:, n - 1] + count[:, n - 1]) << 1
            limit[:, n] = (first[:, n] + count[:, n]) << (LONGEST - n)
        self.single = count.sum(axis=1) == 1
        if (limit[~self.single, LONGEST] != 1 << LONGEST).any() or (limit > 1 << LONGEST)[~self.single].any():
            raise ValueError("a prefix code isn't complete")
        by = _sorted((owner, _room(owner)), (flat, 4))
        order, owner, flat = used[by], owner[by], flat[by]
        begin = (np.cumsum(count.ravel()) - count.ravel()).reshape(-1, 16)
        rank = np.arange(len(order)) - begin[owner, flat]
        code, single = (first[owner, flat] + rank) << (LONGEST - flat), self.single[owner]
        # Bits and number of bits of every symbol.
        self.length, self.word = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        self.length[order] = np.where(single, 0, flat)
        self.word[order] = np.where(single, 0, REVERSED[np.minimum(code, (1 << LONGEST) - 1)])
        self.order, self.owner = order, owner

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All codes' tables one after another, where each begins, and the bits each looks at: the longest word's. An entry is symbol * 16 + length.

        With words in order, highest bit first, a symbol's entries stand together, so a table is its symbols repeated.
        """
        owner, length = self.owner, self.length[self.order]
        longest = np.zeros(len(self.offset), np.int64)
        # A code's symbols stand together, the longest word last.
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else owner
        longest[owner[ends]] = length[ends]
        # The largest alphabet has 2,328 symbols.
        entries = ((self.order - self.offset[owner]) * 16 + length).astype(np.uint16)
        return np.repeat(entries, 1 << (longest[owner] - length)), np.cumsum(1 << longest) - (1 << longest), longest


@dataclass
class Coded:
    """A block of coded pixels that starts at bit `at`: groups of five lists of code lengths, and which group each tile has."""

    bits: Bits
    width: int
    height: int
    cache: int
    codes: list[list[np.ndarray]]
    tiles: np.ndarray | None = None
    tile_bits: int = 0
    phase: tuple[bool, int] = (True, 0)


def _tiled(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


@dataclass
class Stored:
    """Code lengths of an alphabet of this size that start at the bits' place: their own code's table, and how many symbols are stored at most."""

    bits: Bits
    size: int
    table: np.ndarray
    left: int
    phase: tuple[bool, int]


@cache
def _length_table(own: tuple[int, ...]) -> np.ndarray:
    """The table of 7 bits for a code of code lengths: symbol * 8 + length."""
    codes = Codes([np.array(own)])
    table, _, longest = codes.tables()
    entry = table[REVERSED[np.arange(128)] >> (LONGEST - longest[0])].astype(np.int64)
    return entry // 16 * 8 + entry % 16


def _lengths(bits: Bits, size: int, phase: tuple[bool, int]) -> Generator[Stored, np.ndarray, np.ndarray]:
    """Code lengths of one alphabet as they are stored."""
    head = bits.peek(19)
    if head & 1:
        out, two, first = np.zeros(size, dtype=np.uint8), head >> 1 & 1, 8 if head >> 2 & 1 else 1
        bits.read(3 + first + 8 * two)
        for s in [head >> 3 & ((1 << first) - 1), *([head >> 3 + first & 255] if two else [])]:
            if s >= size:
                raise ValueError("a symbol outside its alphabet")
            out[s] = 1
        return out
    own, many = [0] * 19, 4 + (head >> 1 & 15)
    three = bits.read(6 + 3 * many) >> 5
    for i, s in enumerate(LENGTH_ORDER[:many]):
        own[s] = three >> 3 * i & 7
    left = 2 + bits.read(2 + 2 * bits.read(3)) if three >> 3 * many else size
    if not any(own):
        raise ValueError("no code for code lengths")
    return (yield Stored(bits, size, _length_table(tuple(own)), left, phase))


def _unrolled(words: np.ndarray, asked: list[Stored]) -> list[np.ndarray]:
    """Stored code lengths of many alphabets, read in lockstep; each one's bits move on."""
    size, left = np.array([a.size for a in asked]), np.array([a.left for a in asked])
    begin, tables = np.array([a.bits.begin for a in asked]), np.stack([a.table for a in asked])
    pos, end = begin + np.array([a.bits.at for a in asked]), begin + np.array([8 * len(a.bits.data) for a in asked])
    out, at, last = np.zeros((len(asked), size.max() + 138), np.uint8), np.zeros(len(asked), np.int64), np.full(len(asked), 8)
    extra, least = np.array([2, 3, 7]), np.array([3, 3, 11])
    lanes, done = np.arange(len(asked)), pos.copy()
    # Of the lanes still at work: the bit, the last length other than zero, and how many lengths and symbols are there and may be.
    while len(lanes):
        window = words.take(pos >> 3) >> (pos & 7)
        entry = tables[lanes, window & 127]
        n, s = entry & 7, entry >> 3
        many = np.where(s < 16, 1, 0)
        i = np.flatnonzero(s >= 16)
        if len(i):
            kind = s[i] - 16
            many[i] = least[kind] + (window[i] >> n[i] & ((1 << extra[kind]) - 1))
            n[i] += extra[kind]
            if len(j := i[kind == 0]):  # the others are zeros
                run, on = _runs(many[j])
                out[lanes[j][run], at[j][run] + on] = last[j][run]
        i = np.flatnonzero((s < 16) & (s > 0))
        found = s.take(i)
        out[lanes.take(i), at.take(i)] = found
        last[i] = found
        at, pos, left = at + many, pos + n, left - 1
        if (at > size).any() or (pos > end).any():
            raise ValueError("code lengths run over")
        if not (on := (at < size) & (left > 0)).all():
            done[lanes] = pos
            on = np.flatnonzero(on)
            lanes, pos, at, left, last, size, end = (x.take(on) for x in (lanes, pos, at, left, last, size, end))
    for a, p in zip(asked, (done - begin).tolist(), strict=True):
        a.bits.at = p
    return [row[: a.size] for row, a in zip(out, asked, strict=True)]


#: Five codes of 11 bits, of which the lowest three say that a code has one symbol of 8 bits.
_ONES, _SINGLES = sum(7 << 11 * k for k in range(5)), sum(5 << 11 * k for k in range(5))


def _block(bits: Bits, width: int, height: int, main: bool) -> Generator[Coded | Stored, np.ndarray, np.ndarray]:
    """The pixels of an image or of a transform's data."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("too large a colour cache")
    tiles, tile_bits = None, 0
    if not main and not cache:
        # Five codes of one symbol of 8 bits each: all pixels are the same.
        five = bits.peek(55)
        if five & _ONES == _SINGLES and five >> 47 < DISTANCES:
            bits.read(55)
            green, red, blue, alpha = (five >> 11 * k + 3 & 255 for k in range(4))
            return np.full(width * height, alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles = ((yield from _block(bits, _tiled(width, tile_bits), _tiled(height, tile_bits), False)) >> 8) & 0xFFFF
        if not tiles.any():
            tiles = None
    sizes = (LITERALS + LENGTHS + (1 << cache if cache else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = []
    for group in range(1 if tiles is None else int(tiles.max()) + 1):
        codes.append([])
        for k, n in enumerate(sizes):
            codes[-1].append((yield from _lengths(bits, n, (main, 5 * group + k))))
    return (yield Coded(bits, width, height, cache, codes, tiles, tile_bits, (main, 1 << 20)))


@dataclass
class Image:
    """Pixels as numbers 0xAARRGGBB, row by row; while it is read, with the transforms still to be inverted."""

    width: int
    height: int
    pixels: np.ndarray
    transforms: list[tuple] = field(default_factory=list)


def _parsed(bits: Bits) -> Generator[Coded | Stored, np.ndarray, Image]:
    head = bits.read(40)
    if head & 255 != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height, version = (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1, head >> 37
    if version:
        raise ValueError("unknown version")
    now, transforms = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t[0] for t in transforms}:
            raise ValueError("a transform twice")
        if kind in (PREDICT, CROSS):
            size = bits.read(3) + 2
            transforms.append((kind, now, size, (yield from _block(bits, _tiled(now, size), _tiled(height, size), False))))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            steps = yield from _block(bits, colours, 1, False)
            shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            transforms.append((kind, now, shift, _joined(np.cumsum(_split(steps), axis=0, dtype=np.uint8))))
            now = _tiled(now, shift)
        else:
            transforms.append((kind, now, 0, None))
    return Image(width, height, (yield from _block(bits, now, height, True)), transforms)


def _split(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red and alpha of pixels."""
    return np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(-1, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, dtype=np.uint8).view("<u4").ravel()


def _slot(pixels: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places in colour caches of 2^bits colours."""
    return (pixels.astype(np.uint32, copy=False) * np.uint32(CACHE_FACTOR) >> (32 - bits).astype(np.uint32)).astype(np.int64)


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths, one after another: the run of each place and its place inside."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def _unpacked(words: np.ndarray, blocks: list[Coded]) -> list[np.ndarray]:
    """The pixels of all blocks. Those with caches or entropy images, which take more work a step, are decoded together, and so are the others."""
    more = [b.cache > 0 or b.tiles is not None for b in blocks]
    out: list = [None] * len(blocks)
    for kind in set(more):
        at = [i for i, m in enumerate(more) if m == kind]
        for i, pixels in zip(at, _together(words, [blocks[i] for i in at]), strict=True):
            out[i] = pixels
    return out


#: Bits that can be read from one word, wherever they begin in a byte.
WINDOW = 57


def _together(words: np.ndarray, blocks: list[Coded]) -> list[np.ndarray]:
    """The pixels of blocks, decoded in lockstep; each block's bits move on behind them."""
    codes = Codes([code for b in blocks for group in b.codes for code in group])
    size, width = np.array([b.width * b.height for b in blocks]), np.array([b.width for b in blocks])
    base = np.cumsum(size) - size
    out, place, end = np.zeros(size.sum(), np.uint32), base.copy(), base + size
    pos = np.array([b.bits.begin + b.bits.at for b in blocks])
    last = np.array([b.bits.begin + 8 * len(b.bits.data) for b in blocks])
    groups = np.array([len(b.codes) for b in blocks])
    own = 5 * (np.cumsum(groups) - groups)
    tiled = np.array([b.tiles is not None for b in blocks])
    tile_bits = np.array([b.tile_bits for b in blocks])
    across = np.array([_tiled(b.width, b.tile_bits) for b in blocks])
    tiles = [b.tiles if b.tiles is not None else np.zeros(0, np.int64) for b in blocks]
    tile_at = np.cumsum([len(t) for t in tiles]) - np.array([len(t) for t in tiles])
    tiles = np.concatenate(tiles).astype(np.int64)
    cache_bits = np.array([b.cache for b in blocks])
    cached = cache_bits > 0
    caches = np.where(cached, 1 << cache_bits, 0)
    cache_at = np.cumsum(caches) - caches
    cache = np.zeros(caches.sum(), np.uint32)
    # What the other channels are where their codes have one symbol each: such pixels cost one symbol.
    first = np.arange(0, len(codes.offset), 5)
    fixed = np.full(len(codes.offset), -1)
    plain = first[codes.single[first + 1] & codes.single[first + 2] & codes.single[first + 3]]
    table, table_at, longest = codes.tables()
    red, blue, alpha = ((table[table_at[plain + k]] >> 4).astype(np.int64) for k in (1, 2, 3))
    fixed[plain] = red << 16 | blue | alpha << 24
    # Where a code's table begins, and the bits of the longest of all words that it doesn't look at.
    most = int(longest.max(initial=0))
    reverse, look = REVERSED[: 1 << most] >> (LONGEST - most), table_at << 4 | most - longest
    mask, whole = (1 << most) - 1, 4 * most <= WINDOW

    def symbol(code, window):
        place = look.take(code)
        return table.take((place >> 4) + (reverse.take(window & mask) >> (place & 15)))

    def window_at(at):
        return words.take(at >> 3) >> (at & 7)

    def value(s, at):
        n = EXTRA[s]
        return BEGIN[s] + (window_at(at) & ((1 << n) - 1)), at + n

    shift, all_cached = (32 - cache_bits).astype(np.uint32), bool(cached.all())

    def remember(lane, pixels):
        if not all_cached:
            some = cached[lane]
            lane, pixels = lane[some], pixels[some]
        cache[cache_at.take(lane) + (pixels * np.uint32(CACHE_FACTOR) >> shift.take(lane))] = pixels

    lanes = np.flatnonzero(size)
    any_tiles, any_cache, any_rich = tiled.any(), cached.any(), len(plain) < len(first)
    # Of the lanes still at work: the place, the bit, and what doesn't change.
    p, at, until, ending, start = place[lanes], pos[lanes], end[lanes], last[lanes], own[lanes]
    while len(lanes):
        code = start
        if any_tiles and len(i := np.flatnonzero(tiled[lanes])):
            code, lane = start.copy(), lanes[i]
            y, x = np.divmod(p[i] - base[lane], width[lane])
            code[i] += 5 * tiles[tile_at[lane] + (y >> tile_bits[lane]) * across[lane] + (x >> tile_bits[lane])]
        window = window_at(at)
        entry = symbol(code, window)
        s, n = (entry >> 4).astype(np.int64), entry & 15
        at = at + n
        step = 1
        i = np.flatnonzero(s < LITERALS)
        if len(i):
            rest, pixels = fixed.take(code.take(i)), s.take(i) << 8
            if any_rich and len(j := np.flatnonzero(rest < 0)):
                k = i if len(j) == len(i) else i[j]
                own_code, bit, left, colour = code.take(k), at.take(k), window.take(k) >> n.take(k), 0
                for kind, up in ((1, 16), (2, 0), (3, 24)):
                    if not whole:
                        left = window_at(bit)
                    entry = symbol(own_code + kind, left)
                    used = entry & 15
                    colour = colour | (entry >> 4).astype(np.int64) << up
                    bit += used
                    left = left >> used
                at[k] = bit
                if k is i:
                    rest = colour
                else:
                    rest[j] = colour
            pixels = (pixels | rest).astype(np.uint32)
            out[p.take(i)] = pixels
            if any_cache:
                remember(lanes.take(i), pixels)
        if len(i) < len(s):
            step = np.ones(len(lanes), np.int64)
            i = np.flatnonzero((s >= LITERALS) & (s < LITERALS + LENGTHS) if any_cache else s >= LITERALS)
            if len(i):
                lane = lanes[i]
                n, to = value(s[i] - LITERALS, at[i])
                entry = symbol(code[i] + 4, window_at(to))
                far, at[i] = value(entry >> 4, to + (entry & 15))
                near = NEAR[np.minimum(far, len(NEAR)) - 1]
                far = np.where(far > len(NEAR), far - len(NEAR), np.maximum(1, near[:, 0] + near[:, 1] * width[lane]))
                if (n > until[i] - p[i]).any() or (far > p[i] - base[lane]).any():
                    raise ValueError("a copy from or to outside the image")
                run, on = _runs(n)
                pixels = out[p[i][run] - far[run] + on % far[run]]
                out[p[i][run] + on] = pixels
                step[i] = n
                if any_cache:
                    remember(lane[run], pixels)
            if any_cache and len(i := np.flatnonzero(s >= LITERALS + LENGTHS)):
                lane = lanes.take(i)
                pixels = cache[cache_at.take(lane) + s.take(i) - LITERALS - LENGTHS]
                out[p.take(i)] = pixels
                # A colour lies at its slot already; nothing, which is black, may come from any.
                if not pixels.all():
                    remember(lane, pixels)
        if (at > ending).any():
            raise ValueError("the stream ends early")
        p = p + step
        if not (on := p < until).all():
            pos[lanes[~on]] = at[~on]
            on = np.flatnonzero(on)
            lanes, p, at, until, ending, start = (x.take(on) for x in (lanes, p, at, until, ending, start))
    for b, at in zip(blocks, pos.tolist(), strict=True):
        b.bits.at = at - b.bits.begin
    return [out[i : i + n] for i, n in zip(base.tolist(), size.tolist(), strict=True)]


class Grid:
    """The pixels of several images one after another, with their columns, rows and the tiles they lie in."""

    def __init__(self, shapes: list[tuple[int, int]], bits: list[int] | None = None):
        width, size = np.array([w for w, _ in shapes]), np.array([w * h for w, h in shapes])
        self.size, self.begin = size, np.cumsum(size) - size
        self.image = image = np.repeat(np.arange(len(size)), size)
        self.width = width[image]
        tall = np.array([h for _, h in shapes])
        of, row = _runs(tall)
        self.y = np.repeat(row, width[of])
        self.x = np.arange(len(image)) - np.repeat(np.cumsum(width[of]) - width[of], width[of])
        if bits is not None:
            self.tiles = many = np.array([_tiled(w, b) * _tiled(h, b) for (w, h), b in zip(shapes, bits, strict=True)])
            across, bits = np.array([_tiled(w, b) for (w, _), b in zip(shapes, bits, strict=True)])[image], np.array(bits)[image]
            self.tile = (np.cumsum(many) - many)[image] + (self.y >> bits) * across + (self.x >> bits)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[i : i + n] for i, n in zip(self.begin.tolist(), self.size.tolist(), strict=True)]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Averages of channels."""
    return (a & b) + ((a ^ b) >> 1)


def _picked(left, top, corner):
    """Left or top, whichever is nearer to left + top - corner."""
    a, b, c = (v.astype(np.int16) for v in (left, top, corner))
    return np.where((np.abs(b - c).sum(axis=1) < np.abs(a - c).sum(axis=1))[:, None], left, top)


def _clamped(a, b, c):
    return np.clip(a.astype(np.int16) + b - c.astype(np.int16), 0, 255).astype(np.uint8)


def _clamped_half(a, c):
    off = a.astype(np.int16) - c
    return np.clip(a + ((off + (off < 0)) >> 1), 0, 255).astype(np.uint8)


#: The predictors by number, of the left, upper, upper right and upper left pixel's channels.
PREDICTORS = {
    1: lambda l, t, r, c: l, 2: lambda l, t, r, c: t, 3: lambda l, t, r, c: r, 4: lambda l, t, r, c: c,
    5: lambda l, t, r, c: _half(_half(l, r), t), 6: lambda l, t, r, c: _half(l, c), 7: lambda l, t, r, c: _half(l, t), 8: lambda l, t, r, c: _half(c, t), 9: lambda l, t, r, c: _half(t, r),
    10: lambda l, t, r, c: _half(_half(l, c), _half(t, r)), 11: lambda l, t, r, c: _picked(l, t, c), 12: lambda l, t, r, c: _clamped(l, t, c), 13: lambda l, t, r, c: _clamped_half(_half(l, t), c),
}
BLACK = np.array([0, 0, 0, 255], dtype=np.uint8)


def _predicted(channels: np.ndarray, at: np.ndarray, width: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """What the pixels at these places are predicted to be. mode: already 0, 1 and 2 at the borders."""
    out = np.empty((len(at), 4), np.uint8)
    out[:] = BLACK
    for m in np.unique(mode).tolist():
        if m in PREDICTORS:
            i = np.flatnonzero(mode == m)
            p, w = at[i], width[i]
            out[i] = PREDICTORS[m](channels[p - 1], channels[p - w], channels[p - w + 1], channels[p - w - 1])
    return out


def _modes(grid: Grid, tiles: np.ndarray) -> np.ndarray:
    mode = (tiles.astype(np.int64) >> 8 & 15)[grid.tile]
    return np.where(grid.y == 0, np.where(grid.x == 0, 0, 1), np.where(grid.x == 0, 2, mode))


def _unpredicted(pixels: np.ndarray, grid: Grid, tiles: np.ndarray) -> np.ndarray:
    """Pixels from what their predictions miss, wave front by wave front."""
    channels, mode, front = _split(pixels).copy(), _modes(grid, tiles), grid.x + 2 * grid.y
    order = np.argsort(front, kind="stable")
    ends = np.cumsum(np.bincount(front))
    for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        at = order[i:j]
        channels[at] += _predicted(channels, at, grid.width[at], mode[at])
    return _joined(channels)


def _unbordered(pixels: np.ndarray, shapes: list[tuple[int, int]]) -> np.ndarray:
    """Pixels of images none of whose tiles looks at a neighbour: only the first row and column follow others."""
    channels = _split(pixels).copy()
    channels += BLACK
    width, tall = (np.array(x) for x in zip(*shapes, strict=True))
    begin = np.cumsum(width * tall) - width * tall
    for many, far in ((width, np.ones_like(width)), (tall, width)):
        for k in range(1, int(many.max())):
            i = np.flatnonzero(many > k)
            at = begin[i] + k * far[i]
            channels[at] += channels[at - far[i]] - BLACK
    return _joined(channels)


def _crossed(pixels: np.ndarray, by: np.ndarray, sign: int) -> np.ndarray:
    """Red and blue less (sign -1) or plus what green and red say about them. by: each pixel's multipliers."""
    channels, by = _split(pixels).copy(), _split(by).view(np.int8).astype(np.int16)
    green, red = channels[:, 1].view(np.int8).astype(np.int16), channels[:, 2].copy()
    channels[:, 2] += (sign * (by[:, 0] * green >> 5)).astype(np.uint8)
    # Blue follows the red that the image has, before (writing) or after (reading) the change.
    whole = (channels[:, 2] if sign > 0 else red).view(np.int8).astype(np.int16)
    channels[:, 0] += (sign * ((by[:, 1] * green >> 5) + (by[:, 2] * whole >> 5))).astype(np.uint8)
    return _joined(channels)


def _greened(pixels: np.ndarray, sign: int) -> np.ndarray:
    channels = _split(pixels).copy()
    by = channels[:, 1] * np.uint8(sign % 256)
    channels[:, 0] += by
    channels[:, 2] += by
    return _joined(channels)


def _coloured(pixels: np.ndarray, packed: int, width: int, height: int, shift: int, palette: np.ndarray) -> np.ndarray:
    """Colours of palette indexes, of which a pixel holds up to eight; an index beyond the palette is transparent black."""
    bits, x = 8 >> shift, np.arange(width)
    index = pixels.reshape(height, packed)[:, x >> shift] >> 8 & 255
    index = index >> ((x & ((1 << shift) - 1)) * bits).astype(np.uint32) & ((1 << bits) - 1)
    return np.append(palette, np.uint32(0))[np.minimum(index, len(palette))].ravel()


def _inverted(images: list[Image]) -> None:
    """Undo the transforms of all images, the last first, images with the same one together."""
    while some := [im for im in images if im.transforms]:
        for kind in {im.transforms[-1][0] for im in some}:
            group = [im for im in some if im.transforms and im.transforms[-1][0] == kind]
            last = [im.transforms.pop() for im in group]
            if kind == PALETTE:
                for im, (_, width, shift, palette) in zip(group, last, strict=True):
                    im.pixels = _coloured(im.pixels, _tiled(width, shift), width, im.height, shift, palette)
                continue
            # Tiles that are all the same need no map of the pixels.
            plain = [kind == GREEN or not (t[3] >> 8 & 15).any() if kind != CROSS else bool((t[3] == t[3][0]).all()) for t in last]
            for now in set(plain):
                some_of = [(im, t) for im, t, p in zip(group, last, plain, strict=True) if p == now]
                flat, shapes = np.concatenate([im.pixels for im, _ in some_of]), [(t[1], im.height) for im, t in some_of]
                ends = np.cumsum([len(im.pixels) for im, _ in some_of]).tolist()
                if kind == GREEN:
                    flat = _greened(flat, 1)
                elif now:
                    flat = _unbordered(flat, shapes) if kind == PREDICT else _crossed(flat, np.repeat(np.array([t[3][0] for _, t in some_of]), [len(im.pixels) for im, _ in some_of]), 1)
                else:
                    grid, tiles = Grid(shapes, [t[2] for _, t in some_of]), np.concatenate([t[3] for _, t in some_of])
                    flat = _unpredicted(flat, grid, tiles) if kind == PREDICT else _crossed(flat, tiles[grid.tile], 1)
                for (im, _), i, j in zip(some_of, [0, *ends[:-1]], ends, strict=True):
                    im.pixels = flat[i:j]


def decoded(streams: list[bytes]) -> list[Image]:
    """The images of lossless streams."""
    begin, buffer = np.cumsum([0, *(8 * len(x) + 64 for x in streams)]).tolist(), b"".join([*(x + bytes(8) for x in streams), bytes(8)])
    # 64 bits from every byte on, of which WINDOW are there from every bit on.
    words = np.ndarray(len(buffer) - 7, "<i8", buffer, 0, (1,)).copy()
    out: list[Image | None] = [None] * len(streams)
    waiting = [(i, _parsed(Bits(data, at)), None) for i, (data, at) in enumerate(zip(streams, begin, strict=False))]
    held: list = []
    while waiting:
        for i, parser, found in waiting:
            try:
                held.append((i, parser, parser.send(found)))
            except StopIteration as done:
                out[i] = done.value
        # Transforms' data first, and one alphabet after another: as many images as possible are in lockstep.
        least = min((a[2].phase for a in held), default=None)
        now, held = [a for a in held if a[2].phase == least], [a for a in held if a[2].phase != least]
        work = _unrolled if now and isinstance(now[0][2], Stored) else _unpacked
        waiting = [(i, parser, found) for (i, parser, _), found in zip(now, work(words, [x for _, _, x in now]) if now else [], strict=True)]
    _inverted(out)
    return out


# Writing.


@dataclass(frozen=True)
class Form:
    """How an image is written: transforms in order, bits of the colour cache, of the entropy image's tiles (0: none) and of the transforms' tiles, pixels of a match at least (0: no matches)."""

    transforms: tuple[int, ...] = ()
    cache: int = 0
    tiles: int = 0
    transform_tiles: int = 4
    match: int = 4


#: Bits of a written word at most. Shorter than the format's limit, so that reading tables are small.
WORD = 11


def huffman(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Code lengths of at most WORD bits for symbols with these counts, of many codes (of, in order), each with two symbols at least.

    Leaves and joined nodes both come in order of their counts, so the two least ones are at the heads of two queues; all codes move on in lockstep.
    """
    out, order = np.zeros(len(counts), np.int64), _sorted((of, _room(of)), (counts, _room(counts)))
    counts, of = counts[order], of[order]
    while len(order):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        many = np.diff(np.r_[first, len(of)])
        # A code's room: its leaves, a guard, its joined nodes, a guard.
        room = np.cumsum(2 * many + 1) - (2 * many + 1)
        code, on = _runs(many)
        place, size = room[code] + on, int((2 * many + 1).sum())
        weight, parent = np.full(size, np.iinfo(np.int64).max), np.arange(size)
        weight[place] = counts
        leaf, joined, new, last = room.copy(), room + many + 1, room + many + 1, room + 2 * many
        while len(leaf):
            sum_ = np.zeros(len(leaf), np.int64)
            for _ in (0, 1):
                x, y = weight[leaf], weight[joined]
                left = x <= y
                parent[np.where(left, leaf, joined)] = new
                sum_ += np.where(left, x, y)
                leaf += left
                joined += ~left
            weight[new] = sum_
            new += 1
            if (on := new < last).all():
                continue
            leaf, joined, new, last = leaf[on], joined[on], new[on], last[on]
        depth = (parent != np.arange(size)).astype(np.int64)
        while (step := depth[parent]).any():
            depth += step
            parent = parent[parent]
        depth = depth[place]
        long = np.maximum.reduceat(depth, first) > WORD
        done = ~long[code]
        out[order[done]] = depth[done]
        counts, of, order = counts[~done] // 2 + 1, of[~done], order[~done]
    return out


_of_lengths = Codes([np.array(LENGTH_CODE)])
_LENGTH_HEAD = [(0, 1), (len(LENGTH_ORDER) - 4, 4), *((LENGTH_CODE[s], 3) for s in LENGTH_ORDER), (0, 1)]


def _stored(some: np.ndarray, code_of: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fields (values and bits) that store the code lengths of alphabets of these sizes, and where each one's begin and end.

    some, code_of and lengths: the symbols that occur, in order, their codes and the lengths of their words.
    """
    many = np.bincount(code_of, minlength=len(sizes))
    largest, least = np.full(len(sizes), 0), np.zeros(len(sizes), np.int64)
    np.maximum.at(largest, code_of, some)
    first = np.cumsum(many) - many
    used = np.flatnonzero(many)
    least[used] = some[first[used]]
    short = (many <= 2) & (largest < 256)
    # The others: zeros before each symbol, its length, and zeros up to the end of the alphabet.
    i, full = np.flatnonzero(~short[code_of]), np.flatnonzero(~short)
    at_code, at_symbol = np.r_[code_of[i], full], np.r_[some[i], sizes[full]]
    word = np.r_[lengths[i], np.full(len(full), -1)]
    order = _sorted((at_code, _room(at_code)), (at_symbol, _room(at_symbol)))
    at_code, at_symbol, word = at_code[order], at_symbol[order], word[order]
    before = np.r_[-1, at_symbol[:-1]]
    before[np.r_[True, at_code[1:] != at_code[:-1]][: len(before)]] = -1
    gap = at_symbol - before[: len(at_symbol)] - 1
    whole, rest = np.divmod(gap, 138)
    tail = np.where(rest >= 3, 2, rest)
    n = 2 * whole + tail + (word >= 0)
    code, length = _of_lengths.word, _of_lengths.length
    entry, on = _runs(n)
    w, on = whole[entry], on
    in_whole, after = on < 2 * w, on - 2 * w
    in_tail, left = ~in_whole & (after < tail[entry]), rest[entry]
    run = np.where(in_whole, 138, left)
    sign = np.where(run >= 11, 18, np.where(run >= 3, 17, 0))
    head = np.where(in_whole, on % 2 == 0, (after == 0) | (left < 3))
    zero_value, zero_bits = np.where(head, code[sign], np.where(sign == 18, run - 11, run - 3)), np.where(head, length[sign], np.where(sign == 18, 7, 3))
    own = np.maximum(word[entry], 0)
    zeros = in_whole | in_tail
    value, bits = np.where(zeros, zero_value, code[own]), np.where(zeros, zero_bits, length[own])
    # All of them: the short ones' fields, or the head of a code of code lengths and what follows.
    body = np.bincount(at_code[entry], minlength=len(sizes))
    fields = np.where(short, 4 + (many == 2), len(_LENGTH_HEAD) + body)
    ends = np.cumsum(fields)
    begin = ends - fields
    values, widths = np.zeros(int(fields.sum()), np.int64), np.zeros(int(fields.sum()), np.int64)
    for k, (v, b) in enumerate(_LENGTH_HEAD):
        values[begin[full] + k], widths[begin[full] + k] = v, b
    c, on = _runs(body)
    values[begin[c] + len(_LENGTH_HEAD) + on], widths[begin[c] + len(_LENGTH_HEAD) + on] = value, bits
    c = np.flatnonzero(short)
    for k, (v, b) in enumerate(((1, 1), (many[c] == 2, 1), (1, 1), (least[c], 8))):
        values[begin[c] + k], widths[begin[c] + k] = v, b
    c = np.flatnonzero(short & (many == 2))
    values[begin[c] + 4], widths[begin[c] + 4] = largest[c], 8
    return values, widths, np.r_[begin, len(values)]


def _before(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each place the last earlier one with the same group and 32-bit key, -1 where there is none."""
    mixed = (keys.astype(np.uint64) ^ group.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    ordered = np.sort(mixed << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
    at, same = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64), ordered[1:] >> np.uint64(32) == ordered[:-1] >> np.uint64(32)
    out = np.full(len(keys), -1)
    out[at[1:][same]] = at[:-1][same]
    out[(out >= 0) & (group[out] != group)] = -1
    return out


def _matches(flat: np.ndarray, grid: Grid, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how far back the same run of pixels was last seen, and how long it stays the same (0: no match)."""
    run = 4
    keys = np.zeros(len(flat), np.uint64)
    rolled = [flat, *(np.append(flat[k:], np.zeros(k, np.uint32)) for k in range(1, run))] if len(flat) >= run else [flat] * run
    for k, x in enumerate(rolled):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64) + np.uint64(k)
    before = _before(grid.image, keys >> np.uint64(32))
    place = np.arange(len(flat))
    left = (grid.begin + grid.size)[grid.image] - place
    fits = (before >= 0) & (left >= run) & (least[grid.image] > 0)
    for x in rolled:
        fits &= x[np.maximum(before, 0)] == x
    far = np.where(fits, place - before, 0)
    # A run of places with the same distance is one long match.
    change = np.flatnonzero(far[1:] != far[:-1]) + 1
    ends = np.append(change, len(far))
    length = np.where(fits, np.repeat(ends, np.diff(np.r_[0, ends])) - place + run - 1, 0)
    length = np.minimum(length, 4096)
    return far, np.where(length >= least[grid.image], length, 0)


def _prefix(values: np.ndarray) -> np.ndarray:
    """The symbols of lengths or distances."""
    return np.searchsorted(BEGIN, values, side="right") - 1


def _near_code(far: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Distance codes: the first near place that means this distance, or the distance behind all of them."""
    out = far + len(NEAR)
    for w in np.unique(width).tolist():
        at = np.maximum(1, NEAR[:, 0] + NEAR[:, 1] * w)
        table = np.zeros(at.max() + 1, np.int64)
        table[at[::-1]] = np.arange(len(NEAR), 0, -1)
        i = np.flatnonzero((width == w) & (far < len(table)))
        code = table[far[i]]
        out[i] = np.where(code > 0, code, out[i])
    return out


def _packed(blocks: list[tuple[np.ndarray, int, int, Form]], heads: list[list]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """For blocks (pixels, width, height, form) the fields (values, bits) of their pixels, and those of their codes, group by group.

    heads: the entropy image of each block (a group for each tile), or None.
    """
    grid = Grid([(w, h) for _, w, h, _ in blocks])
    flat, cache = np.concatenate([b[0] for b in blocks]), np.array([b[3].cache for b in blocks])
    far, length = _matches(flat, grid, np.array([b[3].match for b in blocks]))
    step, taken = np.maximum(length, 1), np.zeros(len(flat), bool)
    at, end = grid.begin[grid.size > 0], (grid.begin + grid.size)[grid.size > 0]
    while len(at):
        taken[at] = True
        at = at + step[at]
        on = at < end
        at, end = at[on], end[on]
    token = np.flatnonzero(taken)
    image, pixels = grid.image[token], flat[token].astype(np.int64)
    copies, hit, slot = length[token] > 0, np.zeros(len(token), bool), np.zeros(len(token), np.int64)
    if len(i := np.flatnonzero(cache[grid.image])):
        slots = _slot(flat[i], cache[grid.image[i]])
        before = _before(grid.image[i], slots)
        same = (before >= 0) & (slots[before] == slots) & (flat[i][before] == flat[i])
        full, where = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64)
        full[i], where[i] = same, slots
        hit, slot = full[token] & ~copies, where[token]
    literal = ~copies & ~hit

    groups = np.array([1 if h is None else int(h.max()) + 1 for h in heads])
    begin = np.cumsum(groups) - groups
    group = begin[image]
    if any(h is not None for h in heads):
        bits = np.array([b[3].tiles for b in blocks])
        across = np.array([_tiled(b[1], b[3].tiles) if h is not None else 0 for b, h in zip(blocks, heads, strict=True)])
        sizes = np.array([0 if h is None else len(h) for h in heads])
        tiles, tile_at = np.concatenate([h for h in heads if h is not None]), np.cumsum(sizes) - sizes
        i = np.flatnonzero(sizes[image] > 0)
        im = image[i]
        group[i] += tiles[tile_at[im] + (grid.y[token[i]] >> bits[im]) * across[im] + (grid.x[token[i]] >> bits[im])]
    # A token is a green symbol; behind it stand three more channels, where they aren't the same all over the image, or the rest of a copy.
    same = np.ones(len(blocks), bool)
    same[grid.image[np.flatnonzero((flat ^ flat[np.minimum(grid.begin, len(flat) - 1)][grid.image]) & 0xFFFF00FF)]] = False
    pair, rich = np.flatnonzero(copies), np.flatnonzero(literal & ~same[image])
    number, back = length[token[pair]], _near_code(far[token[pair]], grid.width[token[pair]])
    long, away = _prefix(number), _prefix(back)
    green = pixels >> 8 & 255
    green[pair], green[hit] = LITERALS + long, LITERALS + LENGTHS + slot[hit]
    owner = np.repeat(np.arange(len(blocks)), groups)
    sizes = np.array([[LITERALS + LENGTHS + (1 << int(cache[o]) if cache[o] else 0), LITERALS, LITERALS, LITERALS, DISTANCES] for o in owner])
    offset = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(-1, 5)
    green += offset[group, 0]
    more = [offset[group[rich], 1 + k] + (pixels[rich] >> shift & 255) for k, shift in enumerate((16, 0, 24))]
    away_at = offset[group[pair], 4] + away
    # Of channels that are the same all over, one symbol is enough to store their codes.
    single = np.flatnonzero(same[owner])
    begun = flat[np.minimum(grid.begin, len(flat) - 1)][owner[single]].astype(np.int64)
    few = np.concatenate([offset[single, 1 + k] + (begun >> shift & 255) for k, shift in enumerate((16, 0, 24))])
    counts = np.bincount(np.concatenate([green, *more, away_at, few]), minlength=int(sizes.sum()))
    some = np.flatnonzero(counts)
    code_of = np.searchsorted(offset.ravel(), some, side="right") - 1
    many = np.bincount(code_of, minlength=sizes.size)
    flat_lengths, lengths = np.zeros(int(sizes.sum()), np.int64), np.ones(len(some), np.int64)
    i = np.flatnonzero(many[code_of] > 1)
    lengths[i] = huffman(counts[some[i]], code_of[i])
    flat_lengths[some] = lengths
    flat_lengths[offset.ravel()[many == 0]] = 1
    head_values, head_bits, head_cuts = _stored(some - offset.ravel()[code_of], code_of, lengths, sizes.ravel())
    codes = Codes(flat_lengths, sizes.ravel())
    fields_of = np.ones(len(token), np.int64)
    fields_of[pair], fields_of[rich] = 4, 4
    ends = np.cumsum(fields_of)
    first = ends - fields_of
    word, bits = np.zeros(int(fields_of.sum()), np.int64), np.zeros(int(fields_of.sum()), np.int64)
    for at, symbol in ((first, green), *((first[rich] + 1 + k, m) for k, m in enumerate(more)), (first[pair] + 2, away_at)):
        word[at], bits[at] = codes.word[symbol], codes.length[symbol]
    for on, symbol, n in ((1, long, number), (3, away, back)):
        word[first[pair] + on], bits[first[pair] + on] = n - BEGIN[symbol], EXTRA[symbol]
    cuts = np.append(0, ends)[np.searchsorted(image, np.arange(len(blocks) + 1))]
    out = [(word[i:j], bits[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    heads_of = [(head_values[i:j], head_bits[i:j]) for i, j in zip(head_cuts[5 * begin].tolist(), head_cuts[5 * (begin + groups)].tolist(), strict=True)]
    return out, heads_of


#: n * log2(n) by n, for the counts of a histogram.
_WEIGHT = np.arange(1 << 15) * np.log2(np.maximum(np.arange(1 << 15), 1))


def _weighed(counts: np.ndarray) -> np.ndarray:
    return _WEIGHT.take(counts) if counts.max(initial=0) < len(_WEIGHT) else counts * np.log2(np.maximum(counts, 1))


def _order(values: np.ndarray, of: np.ndarray, many: int, wide: int = 256) -> np.ndarray:
    """How much order (bits less than if all were different) values below `wide` have in each of many groups."""
    return _weighed(np.bincount(of * wide + values, minlength=many * wide)).reshape(many, wide).sum(axis=1)


def _better(best: np.ndarray, order: np.ndarray, choice: np.ndarray, now: np.ndarray, least: np.ndarray) -> None:
    """Take what gives `least` bits more order than the best so far."""
    i = order > best + least
    best[i], choice[i] = order[i], now[i] if np.ndim(now) else now


def _tile_modes(pixels: np.ndarray, grid: Grid) -> np.ndarray:
    """Each tile's predictor: of what it leaves of green, the one with the fewest bits; black (0) unless another saves an eighth of a bit a pixel."""
    many, green = int(grid.tiles.sum()), _split(pixels)[:, 1:2]
    at = np.flatnonzero((grid.y > 0) & (grid.x > 0))
    tile, w = grid.tile[at], grid.width[at]
    near, own = [green[at - 1], green[at - w], green[at - w + 1], green[at - w - 1]], green[at]
    best, mode = _order(own[:, 0], tile, many), np.zeros(many, np.uint32)
    best = best + np.bincount(tile, minlength=many) / 8
    for m, f in PREDICTORS.items():
        _better(best, _order((own - f(*near))[:, 0], tile, many), mode, m, 0)
    return (OPAQUE | mode << 8).astype(np.uint32)


def _tile_multipliers(pixels: np.ndarray, grid: Grid) -> np.ndarray:
    """Each tile's colour multipliers: none, those that undo subtracted green, or the fitted ones, whichever leave the fewest bits."""
    many, channels = int(grid.tiles.sum()), _split(pixels)
    blue, green, red = (channels[:, k].view(np.int8).astype(np.int16) for k in range(3))
    least, found = np.bincount(grid.tile, minlength=many) / 32, np.zeros((many, 4), np.uint8)
    found[:, 3] = 255

    n = np.maximum(np.bincount(grid.tile, minlength=many), 1)
    sums = lambda v: np.bincount(grid.tile, weights=v, minlength=many)
    own = {id(x): (v := x.astype(np.float64), (total := sums(v)), np.maximum(sums(v * v) - total**2 / n, 1)) for x in (green, red)}

    def fitted(y, x):
        # A multiplier of 32 takes all of x away.
        v, total, spread = own[id(x)]
        return np.clip(np.rint(32 * (sums(v * y) - total * sums(y) / n) / spread), -128, 127).astype(np.int16)

    left = blue
    for place, y, x in ((0, red, green), (1, left, green), (2, None, red)):
        y = left if y is None else y
        best, choice = _order(y.view(np.uint16) & 255, grid.tile, many), np.zeros(many, np.int16)
        for by in (*([np.full(many, -32, np.int16)] if x is green else []), fitted(y, x)):
            _better(best, _order((y - (by[grid.tile] * x >> 5)).view(np.uint16) & 255, grid.tile, many), choice, by, least)
        found[:, place] = choice.astype(np.int8).view(np.uint8)
        if place == 1:
            left = y - (choice[grid.tile] * x >> 5)
    return _joined(found)


def _paletted(image: Image) -> tuple[np.ndarray, int, tuple]:
    """An image as indexes of its colours, its packed width, and the transform's kind, size and data."""
    colours, index = np.unique(image.pixels, return_inverse=True)
    if len(colours) > 256:
        raise ValueError("too many colours for a palette")
    shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    packed = np.zeros((image.height, _tiled(image.width, shift) << shift), np.uint32)
    packed[:, : image.width] = index.reshape(image.height, image.width)
    packed = packed.reshape(image.height, -1, 1 << shift)
    packed = (packed << (np.arange(1 << shift, dtype=np.uint32) * (8 >> shift))).sum(axis=2, dtype=np.uint32)
    steps = _split(colours).copy()
    steps[1:] -= _split(colours)[:-1]
    return (OPAQUE | packed << 8).astype(np.uint32).ravel(), _tiled(image.width, shift), (PALETTE, len(colours), _joined(steps))


def _transformed(images: list[Image], forms: list[Form]) -> list[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray | None]]]]:
    """Pixels and width of each image after its form's transforms, and each one's kind, size and data. Images take the same step together."""
    pixels, width, data = [np.asarray(im.pixels, np.uint32) for im in images], [im.width for im in images], [[] for _ in images]
    for step in range(max((len(f.transforms) for f in forms), default=0)):
        group: dict[int, list[int]] = {}
        for i, f in enumerate(forms):
            if step < len(f.transforms):
                group.setdefault(f.transforms[step], []).append(i)
        for kind, some in group.items():
            if kind == PALETTE:
                for i in some:
                    pixels[i], width[i], made = _paletted(Image(width[i], images[i].height, pixels[i]))
                    data[i].append(made)
                continue
            flat, ends = np.concatenate([pixels[i] for i in some]), np.cumsum([len(pixels[i]) for i in some]).tolist()
            if kind == GREEN:
                flat, tiles = _greened(flat, -1), None
            else:
                grid = Grid([(width[i], images[i].height) for i in some], [forms[i].transform_tiles for i in some])
                if kind == PREDICT:
                    tiles, channels = _tile_modes(flat, grid), _split(flat)
                    mode = _modes(grid, tiles)
                    predicted = np.empty_like(channels)
                    predicted[:] = BLACK
                    at = np.flatnonzero(mode)
                    predicted[at] = _predicted(channels, at, grid.width[at], mode[at])
                    flat = _joined(channels - predicted)
                else:
                    tiles = _tile_multipliers(flat, grid)
                    flat = _crossed(flat, tiles[grid.tile], -1)
                tile_ends = np.cumsum(grid.tiles).tolist()
            for n, i in enumerate(some):
                pixels[i] = flat[ends[n - 1] if n else 0 : ends[n]]
                data[i].append((kind, 0, None) if tiles is None else (kind, forms[i].transform_tiles, tiles[tile_ends[n - 1] if n else 0 : tile_ends[n]]))
    return list(zip(pixels, width, data, strict=True))


#: What a group of codes costs, in bits: so many, and so many for each symbol that occurs.
GROUP, SYMBOL = 60, 4


def _groups(blocks: list[tuple[np.ndarray, int, int, int]]) -> list[np.ndarray]:
    """The entropy images of images (pixels, width, height, bits of a tile): a row of tiles goes on with the group before it unless a group of its own takes fewer bits."""
    tall = np.array([_tiled(h, bits) for _, _, h, bits in blocks])
    width, height, bits = (np.array([b[k] for b in blocks]) for k in (1, 2, 3))
    begin, flat = np.cumsum(tall) - tall, np.concatenate([b[0] for b in blocks])
    of, row = _runs(height)
    band = np.repeat(begin[of] + (row >> bits[of]), width[of])
    counts = np.bincount((band[:, None] * 1024 + np.arange(4) * 256 + _split(flat)).ravel(), minlength=1024 * int(tall.sum())).astype(np.int32).reshape(-1, 1024)

    def cost(c):
        return _weighed(c.reshape(-1, 4, 256).sum(axis=2)).sum(axis=1) - _weighed(c).sum(axis=1) + SYMBOL * np.count_nonzero(c, axis=1) + GROUP

    group, now = np.zeros(len(counts), np.int64), counts[begin].copy()
    for k in range(1, int(tall.max())):
        i = np.flatnonzero(tall > k)
        own = counts[begin[i] + k]
        both = now[i] + own
        new = cost(now[i]) + cost(own) < cost(both)
        group[begin[i] + k] = group[begin[i] + k - 1] + new
        now[i] = np.where(new[:, None], own, both)
    return [np.repeat(group[b : b + n], _tiled(w, t)) for b, n, (_, w, _, t) in zip(begin.tolist(), tall.tolist(), blocks, strict=True)]


@lru_cache(1 << 12)
def _constant(pixel: int) -> tuple[np.ndarray, np.ndarray]:
    """Fields of a block all of whose pixels are the same: no cache, five codes of one symbol each."""
    symbols = (pixel >> 8 & 255, pixel >> 16 & 255, pixel & 255, pixel >> 24, 0)
    return np.array([0, *(v for s in symbols for v in (1, 0, 1, s))]), np.array([1, *(1, 1, 1, 8) * 5])


def encoded(images: list[Image], forms: list[Form]) -> list[bytes]:
    """Lossless streams of images."""
    sub, blocks, heads, plans = Form(match=0), [], [], []

    def block(pixels, width, height, form, head=None) -> int:
        blocks.append((pixels, width, height, form))
        heads.append(head)
        return len(blocks) - 1

    def data_block(pixels, width, height) -> int | tuple:
        return _constant(int(pixels[0])) if (pixels == pixels[0]).all() else block(pixels, width, height, sub)

    done = _transformed(images, forms)
    clear = np.minimum.reduceat(np.concatenate([im.pixels for im in images]), np.cumsum([0, *(len(im.pixels) for im in images[:-1])])) < OPAQUE if images else []
    tiled = [i for i, f in enumerate(forms) if f.tiles]
    entropy = dict(zip(tiled, _groups([(done[i][0], done[i][1], images[i].height, forms[i].tiles) for i in tiled]) if tiled else [], strict=True))
    for i, (im, form, (pixels, width, data)) in enumerate(zip(images, forms, done, strict=True)):
        # Fields, or places of blocks whose fields follow when all blocks are packed.
        plan: list = [(SIGNATURE, 8), (im.width - 1, 14), (im.height - 1, 14), (int(clear[i]), 1), (0, 3)]
        now = im.width
        for kind, size, tiles in data:
            plan += [(1, 1), (kind, 2), *([(size - 2, 3)] if kind in (PREDICT, CROSS) else [(size - 1, 8)] if kind == PALETTE else [])]
            if kind == PALETTE:
                plan.append(data_block(tiles, size, 1))
                now = width
            elif tiles is not None:
                plan.append(data_block(tiles, _tiled(now, size), _tiled(im.height, size)))
        plan += [(0, 1), *([(1, 1), (form.cache, 4)] if form.cache else [(0, 1)])]
        if (head := entropy.get(i)) is not None:
            plan += [(1, 1), (form.tiles - 2, 3), data_block((OPAQUE | head.astype(np.uint32) << 8).astype(np.uint32), _tiled(width, form.tiles), _tiled(im.height, form.tiles))]
        else:
            plan.append((0, 1))
        plan.append(~block(pixels, width, im.height, form, head))
        plans.append(plan)
    tokens, codes = _packed(blocks, heads)
    out = []
    for plan in plans:
        parts, fields = [], []
        for piece in plan:
            if isinstance(piece, tuple) and isinstance(piece[0], int):
                fields.append(piece)
                continue
            at = piece
            if isinstance(piece, int):
                at = piece if piece >= 0 else ~piece
                if piece >= 0:  # a block inside the stream says that it has no cache
                    fields.append((0, 1))
            pair = np.array(fields, dtype=np.int64)
            fields.clear()
            parts += [(pair[:, 0], pair[:, 1])] if len(pair) else []
            parts += [codes[at], tokens[at]] if isinstance(piece, int) else [piece]
        out.append(parts)
    return _bytes(out)


def _bytes(streams: list[list[tuple[np.ndarray, np.ndarray]]]) -> list[bytes]:
    """Bytes of streams of fields (values, bits), lowest bits first. Fields share no bit, so sums put them together."""
    values, bits = (np.concatenate([part[k] for parts in streams for part in parts]) for k in (0, 1))
    many = np.array([sum(len(b) for _, b in parts) for parts in streams])
    ends = np.cumsum(bits)
    before = np.append(0, ends)[np.append(0, np.cumsum(many))]
    sizes = np.diff(before)
    begin = np.cumsum(np.append(0, (sizes + 31) // 32))
    pos = ends - bits + np.repeat(32 * begin[:-1] - before[:-1], many)
    shifted, place = values << (pos & 31), pos >> 5
    # Places rise, so the fields that begin in a word stand together.
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    words = np.zeros(int(begin[-1]) + 2, np.int64)
    words[place[first]] = np.add.reduceat(shifted & 0xFFFFFFFF, first)
    words[place[first] + 1] += np.add.reduceat(shifted >> 32, first)
    data = words.astype("<u4").tobytes()
    return [data[4 * i : 4 * i + (n + 7) // 8] for i, n in zip(begin.tolist(), sizes.tolist(), strict=False)]


# Files.


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + len(data).to_bytes(4, "little") + data + bytes(len(data) & 1)


def file_of(streams: list[bytes], sizes: list[tuple[int, int]]) -> bytes:
    """A file of one image, or of frames below each other on one canvas; all but the last have even heights."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        small = lambda n: n.to_bytes(3, "little")
        body = _chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + small(max(w for w, _ in sizes) - 1) + small(sum(h for _, h in sizes) - 1)) + _chunk(b"ANIM", bytes(6))
        parts, y = [body], 0
        for stream, (w, h) in zip(streams, sizes, strict=True):
            parts.append(_chunk(b"ANMF", small(0) + small(y // 2) + small(w - 1) + small(h - 1) + small(0) + b"\x02" + _chunk(b"VP8L", stream)))
            y += h
        body = b"".join(parts)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def frames_of(data: bytes) -> list[bytes]:
    """The lossless streams of a file, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or int.from_bytes(data[4:8], "little") + 8 > len(data):
        raise ValueError("not a whole WebP file")

    def chunks(part: bytes):
        at = 0
        while at + 8 <= len(part):
            n = int.from_bytes(part[at + 4 : at + 8], "little")
            if at + 8 + n > len(part):
                raise ValueError("a chunk runs over")
            yield part[at : at + 4], part[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)

    out = []
    for name, part in chunks(data[12:]):
        if name == b"VP8L":
            out.append(part)
        elif name == b"ANMF":
            out += [p for inner, p in chunks(part[16:]) if inner == b"VP8L"]
    return out


def channels_of(images: list[Image]) -> bytes:
    """Red, green, blue and alpha of images below each other."""
    return b"".join(np.ascontiguousarray(_split(im.pixels)[:, [2, 1, 0, 3]]).tobytes() for im in images)
