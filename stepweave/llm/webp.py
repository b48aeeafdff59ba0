"""Media columns as lossless WebP (RFC 9649): a whole decoder, a writer, and their use on columns.

The decoder handles prefix codes (simple, normal, grouped by an entropy image), back-references, the colour cache and the
four transforms. The writer stores bytes as images, a byte a pixel as a grey or four bytes a pixel, as the samples' entropy
suggests: grey after subtracting green; a palette of up to 16 greys, several a pixel; predicted from neighbours, block by
block; or four channels as they are, less green, or less what green and red foretell of red and blue. Repeated runs become
back-references, repeated pixels of four bytes colour cache entries; all is written in prefix codes of its own counts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, each, load, text_or_empty

# Fixed values of the format (RFC 9649): the order of code length codes; the near pixels, columns left and rows up, that the
# first 120 distance codes name.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
ALPHABETS = (280, 256, 256, 256, 40)
#: Pixels in a row where a pixel holds one byte, and where it holds four; rows (64 bytes) in one image: a longer payload takes several.
GREY, PACKED, ROWS = 64, 16, 4096
#: Longest prefix code that is written; shortest and longest run that becomes a back-reference, in bytes and pixels.
LONGEST, LEAST_RUN, MOST_RUN = 10, 8, 512
#: Marks an entry of two literals.
PAIR = 1 << 20
_REVERSED = np.array([int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)], np.int64)


class Bits:
    """Reads numbers from bytes, lowest bit first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        end = self.at + n
        if end > len(self.data) * 8:
            raise ValueError("the image ends early")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : (end + 7) >> 3], "little") >> (self.at & 7)
        self.at = end
        return value & ((1 << n) - 1)

    def peek(self) -> int:
        """The next 15 bits; zeros beyond the end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 3], "little") >> (self.at & 7) & 0x7FFF

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > len(self.data) * 8:
            raise ValueError("the image ends early")


class Code:
    """A canonical prefix code, by symbol's lengths: a table of symbol * 16 + length by the next bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.single, self.mask, self.table = int(used[0]), 0, [int(used[0]) << 4]
            return
        self.single = None
        own = lengths[used]
        order = np.argsort(own, kind="stable")
        used, own = used[order], own[order].astype(np.int64)
        if int((1 << (15 - own)).sum()) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        high = int(own[-1])
        # in canonical order each code stands for the next 2 ** (high - length) values of high bits, the first bit highest
        table = np.repeat(used << 4 | own, 1 << (high - own))
        self.mask, self.table = (1 << high) - 1, table[_REVERSED[: 1 << high] >> (15 - high)].tolist()

    def pairs(self) -> np.ndarray:
        """The table with two literals in one entry, PAIR and a byte each, wherever the bits hold both."""
        one = np.array(self.table, np.int64)
        size = one & 15
        two = one[(np.arange(len(one)) >> size) & self.mask]
        both = size + (two & 15)
        fits = (one < 4096) & (two < 4096) & (both <= self.mask.bit_length()) & (both < 16) & (size > 0)
        return np.where(fits, PAIR | (two >> 4) << 12 | one & 4080 | both, one).astype(np.int32)

    def read(self, bits: Bits) -> int:
        e = self.table[bits.peek() & self.mask]
        bits.skip(e & 15)
        return e >> 4


@lru_cache(256)
def _length_code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


@lru_cache(4096)
def _simple_code(size: int, *symbols: int) -> Code:
    lengths = np.zeros(size, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        return _simple_code(size, first, bits.read(8) if two else first)
    lengths = np.zeros(size, np.int64)
    own = np.zeros(19, np.int64)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last = _length_code(own.tobytes()), 0, 8
    table, mask, out = code.table, code.mask, []
    data, p = bits.data, bits.at >> 3
    word, have = int.from_bytes(data[p : p + 8], "little") >> (bits.at & 7), 64 - (bits.at & 7)
    p += 8
    while at < size and most:
        most -= 1
        if have < 32:
            word |= int.from_bytes(data[p : p + 4], "little") << have
            have += 32
            p += 4
        e = table[word & mask]
        k = e & 15
        word >>= k
        have -= k
        e >>= 4
        if e < 16:
            out.append(e)
            last, at = e or last, at + 1
            continue
        extra, base, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[e - 16]
        n = base + (word & ((1 << extra) - 1))
        word >>= extra
        have -= extra
        at += n
        if at > size:
            raise ValueError("code lengths run over")
        out += [value] * n
    bits.at = p * 8 - have
    if bits.at > len(data) * 8:
        raise ValueError("the image ends early")
    lengths[: len(out)] = out
    return Code(lengths)


def _span(code: int, bits: Bits) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


@lru_cache(64)
def _by_distance(width: int) -> dict[int, int]:
    return {d: k + 1 for k, d in reversed(list(enumerate(_near(width))))}


@lru_cache(64)
def _near(width: int) -> list[int]:
    return [max(1, y * width + x) for x, y in NEAR]


def _run(data: bytes, at: int, codes: list[Code], near: list[int]) -> tuple[int, int, int]:
    """A back-reference whose green code begins at a bit: (the bit behind it, length, how far back)."""
    word = int.from_bytes(data[at >> 3 : (at >> 3) + 10], "little") >> (at & 7)
    e = codes[0].table[word & codes[0].mask]
    took, spans = e & 15, []
    word >>= took
    for code in ((e >> 4) - 256, None):
        if code is None:
            e = codes[4].table[word & codes[4].mask]
            code = e >> 4
            word >>= e & 15
            took += e & 15
        extra = 0 if code < 4 else (code - 2) >> 1
        spans.append(code + 1 if code < 4 else ((2 + (code & 1)) << extra) + (word & ((1 << extra) - 1)) + 1)
        word >>= extra
        took += extra
    return at + took, spans[0], spans[1] - 120 if spans[1] > 120 else near[spans[1] - 1]


def _greens(bits: Bits, codes: list[Code], n: int, width: int) -> np.ndarray:
    """The green samples of an image whose other channels are each of one value, without a cache; the last of its file.

    What each bit would begin, and where the next code would then be, is told for all bits at once; a walk over these picks the
    bits at which codes do begin. One step may be two literals.
    """
    start, data = bits.at, bits.data
    if codes[0].single is not None:
        return np.full(n, codes[0].single, np.uint8)
    raw = np.zeros(len(data) - (start >> 3) + 2, np.uint32)
    raw[:-2] = np.frombuffer(data, np.uint8, offset=start >> 3)
    three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    window = (three[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32(codes[0].mask)).ravel()[start & 7 :]
    entry = codes[0].pairs()[window]
    size = entry & 15
    after = np.arange(len(entry), dtype=np.int32) + size
    after[(entry >= 4096) & (entry < PAIR)] = -1
    step, end, near, seen, runs = memoryview(after), len(entry), _near(width), [], []
    at, left, add = 0, n, seen.append
    while at < end:
        add(at)
        nxt = step[at]
        if nxt < 0:
            nxt, length, back = _run(data, start + at, codes, near)
            nxt -= start
            runs.append((len(seen) - 1, length, back))
            left -= length
            if left <= 0:
                break
        at = nxt
    found = entry[np.array(seen, np.int64)]
    counts = np.where(found >= PAIR, 2, 1)
    for k, length, _ in runs:
        counts[k] = length
    ends = np.cumsum(counts)
    if not len(ends) or ends[-1] < n:
        raise ValueError("the image ends early")
    places = ends - counts
    out = np.zeros(int(ends[-1]), np.uint8)
    out[places] = found >> 4 & 255
    two = np.flatnonzero(found >= PAIR)
    out[places[two] + 1] = found[two] >> 12 & 255
    for k, length, back in runs:
        p = int(places[k])
        if p >= n:
            break
        if back > p or p + length > n:
            raise ValueError("a back-reference out of the image")
        if back >= length:
            out[p : p + length] = out[p - back : p - back + length]
        else:
            out[p : p + length] = np.resize(out[p - back : p], length)
    bits.at = len(data) * 8
    return out[:n]


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB pixels of an entropy-coded image, row by row; top: the image itself, not one that a transform or the codes need."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of over 11 bits")
    groups, block, meta = 1, 0, None
    if top and bits.read(1):
        block = bits.read(3) + 2
        meta = (_read_image(bits, -(-width >> block), -(-height >> block), False) >> 8).astype(np.int64) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    codes = [[_read_code(bits, s) for s in sizes] for _ in range(groups)]
    n = width * height
    red, blue, alpha = (c.single for c in codes[0][1:4])
    if top and groups == 1 and not cache_bits and None not in (red, blue, alpha):
        return _greens(bits, codes[0], n, width).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
    out, cache, near = [0] * n, [0] * (1 << cache_bits), _near(width)
    across = -(-width >> block) if meta is not None else 0
    own, at, kept = codes[0], 0, 0
    while at < n:
        if meta is not None:
            own = codes[meta[(at // width >> block) * across + (at % width >> block)]]
        s = own[0].read(bits)
        if s < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _span(s - 256, bits)
            code = _span(own[4].read(bits), bits)
            back = code - 120 if code > 120 else near[code - 1]
            if back > at or at + length > n:
                raise ValueError("a back-reference out of the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            while kept < at:
                cache[(0x1E35A7BD * out[kept] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[kept]
                kept += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _split(p: np.ndarray) -> list[np.ndarray]:
    return [(p >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0)]


def _join(a, r, g, b) -> np.ndarray:
    a, r, g, b = ((np.asarray(x) & 255).astype(np.uint32) for x in (a, r, g, b))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def predicted(mode: int, left, top, top_right, top_left) -> tuple[int, ...]:
    """A pixel (four channels, alpha first) foretold from its neighbours."""
    half = lambda x, y: tuple((i + j) >> 1 for i, j in zip(x, y, strict=True))
    held = lambda x: min(255, max(0, x))
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return half(half(left, top_right), top)
        case 6:
            return half(left, top_left)
        case 7:
            return half(left, top)
        case 8:
            return half(top_left, top)
        case 9:
            return half(top, top_right)
        case 10:
            return half(half(left, top_left), half(top, top_right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
            to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
            return left if to_left < to_top else top
        case 12:
            return tuple(held(x + t - c) for x, t, c in zip(left, top, top_left, strict=True))
        case 13:
            mid = half(left, top)
            return tuple(held(m + int((m - c) / 2)) for m, c in zip(mid, top_left, strict=True))
    return (255, 0, 0, 0)


def _undo_predictor(p: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    rest = np.stack(_split(p), axis=1).tolist()
    across = -(-width >> block)
    out: list[tuple[int, ...]] = []
    for at, d in enumerate(rest):
        y, x = divmod(at, width)
        if y == 0:
            own = out[at - 1] if x else (255, 0, 0, 0)
        elif x == 0:
            own = out[at - width]
        else:
            own = predicted(int(modes[(y >> block) * across + (x >> block)]), out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
        out.append(tuple((i + j) & 255 for i, j in zip(own, d, strict=True)))
    return _join(*np.array(out, np.int64).reshape(-1, 4).T)


def _by_block(values: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    return values[(y >> block) * -(-width >> block) + (x >> block)]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def cross_colour(p: np.ndarray, width: int, height: int, factors: np.ndarray, block: int, sign: int = 1) -> np.ndarray:
    """Undoes (sign 1) or applies (-1) the cross-colour transform."""
    a, r, g, b = _split(p)
    _, red_blue, green_blue, green_red = (_signed(x) for x in _split(_by_block(factors, width, height, block)))
    red = r + sign * (green_red * _signed(g) >> 5)
    known = _signed((red if sign > 0 else r) & 255)
    return _join(a, red, g, b + sign * ((green_blue * _signed(g) >> 5) + (red_blue * known >> 5)))


def _add_green(p: np.ndarray) -> np.ndarray:
    own = p.astype("<u4").view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    own[:, 0] += own[:, 1]
    own[:, 2] += own[:, 1]
    return own.view("<u4").ravel()


def _undo_palette(p: np.ndarray, width: int, height: int, colours: np.ndarray, pack: int) -> np.ndarray:
    index = (p >> np.uint32(8) & np.uint32(255)).astype(np.int64).reshape(height, -1)
    if pack:
        x, depth = np.arange(width), 8 >> pack
        index = index[:, x >> pack] >> (x & ((1 << pack) - 1)) * depth & ((1 << depth) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index.ravel()]


def decode(image: bytes) -> np.ndarray:
    """One lossless WebP file to its ARGB pixels, height x width, uint32."""
    if image[:4] != b"RIFF" or image[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, body = 12, None
    while at + 8 <= len(image):
        kind, size = image[at : at + 4], struct.unpack_from("<I", image, at + 4)[0]
        if kind == b"VP8L":
            body = image[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if body is None or body[:1] != b"\x2f":
        raise ValueError("no lossless image in it")
    bits = Bits(body[1:])
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("an unknown version")
    undo, own, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            block = bits.read(3) + 2
            extra = _read_image(bits, -(-own >> block), -(-height >> block), False)
            w = own
            if kind:
                undo.append(lambda p, w=w, e=extra, k=block: cross_colour(p, w, height, e, k))
            else:
                undo.append(lambda p, w=w, e=(extra >> 8).astype(np.int64) & 15, k=block: _undo_predictor(p, w, height, e, k))
        elif kind == 2:
            undo.append(_add_green)
        else:
            n = bits.read(8) + 1
            steps = np.stack(_split(_read_image(bits, n, 1, False)), axis=1)
            colours = _join(*np.cumsum(steps, axis=0).T)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, w=own, c=colours, k=pack: _undo_palette(p, w, height, c, k))
            own = -(-own >> pack)
    pixels = _read_image(bits, own, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels.reshape(height, width)


# --- writing


def riff(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


class BitWriter:
    """Numbers of at most 30 bits, lowest bit first; ``array`` takes many at once."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.widths: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.widths.append(n)

    def array(self, values: np.ndarray, widths: np.ndarray) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.widths, np.int64)))
            self.values, self.widths = [], []
        self.parts.append((values.astype(np.uint64), widths.astype(np.int64)))

    def bytes(self) -> bytes:
        self.array(np.empty(0), np.empty(0))
        values, widths = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ends = np.cumsum(widths)
        at = ends - widths
        total, word = int(ends[-1]) if len(ends) else 0, at >> 5
        shifted = values << (at & 31).astype(np.uint64)
        # bits of different numbers never meet, so sums of words are exact: below 2 ** 32
        words = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), (total >> 5) + 2) + np.bincount(word + 1, (shifted >> np.uint64(32)).astype(np.float64), (total >> 5) + 2)
        return words.astype("<u4").tobytes()[: (total + 7) // 8]


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of a prefix code for counts, none over ``longest``; a lone symbol's is 1."""
    out, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(used) < 3:
        out[used] = 1
        return out
    own = counts[used].astype(np.int64)
    order = np.argsort(own, kind="stable")
    while True:
        leaves = [*own[order].tolist(), 1 << 62, 1 << 62]
        n = len(order)
        # the two least of leaves and of sums so far, both in ascending order, become a sum
        sums, up, i, j = [1 << 62] * (n + 1), [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):
            if leaves[i] <= sums[j]:
                x = leaves[i]
                up[i] = k
                i += 1
            else:
                x = sums[j]
                up[n + j] = k
                j += 1
            if leaves[i] <= sums[j]:
                sums[k] = x + leaves[i]
                up[i] = k
                i += 1
            else:
                sums[k] = x + sums[j]
                up[n + j] = k
                j += 1
        depth = [0] * (n - 1)
        for k in range(n - 3, -1, -1):
            depth[k] = depth[up[n + k]] + 1
        lengths = [depth[k] + 1 for k in up[:n]]
        if max(lengths) <= longest:
            out[used[order]] = lengths
            return out
        own = (own >> 1) + 1  # rarer symbols come nearer to the others


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as they are written, the first bit lowest; a lone symbol takes no bits."""
    out, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[order]
    step = 1 << (15 - own)
    out[order] = _REVERSED[np.cumsum(step) - step]  # as 15 bits, the first highest; turned round, the first lowest
    return out


def _put_code(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 3 and all(k < 256 for k in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    w.put(0, 1)
    ends = [*(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    rows: list[tuple[int, int, int]] = []  # code of code lengths, extra, its bits
    at = 0
    for end in ends:
        length, n = int(lengths[at]), end - at
        at = end
        if length == 0:
            while n >= 3:
                m = min(n, 138)
                rows.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
                n -= m
        elif n > 3:
            rows.append((length, 0, 0))
            n -= 1
            while n >= 3:
                m = min(n, 6)
                rows.append((16, m - 3, 2))
                n -= m
        rows += [(length, 0, 0)] * n
    own = code_lengths(np.bincount([r[0] for r in rows], minlength=19), 7)
    codes = canonical(own)
    last = max(k for k in range(19) if own[CODE_LENGTH_ORDER[k]]) + 1
    w.put(max(last, 4) - 4, 4)
    for k in CODE_LENGTH_ORDER[: max(last, 4)]:
        w.put(int(own[k]), 3)
    w.put(0, 1)
    widths = (own if (own > 0).sum() > 1 else np.zeros_like(own)).tolist()
    code_of = codes.tolist()
    # a row's code and extra bits follow each other: one number
    w.values += [code_of[k] | extra << widths[k] for k, extra, _ in rows]
    w.widths += [widths[k] + n for k, _, n in rows]


def _prefixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra, bits of extra) of numbers from 1 on."""
    v = x.astype(np.int64) - 1
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 0)
    small = v < 4
    bits = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(small, 0, v & ((1 << bits) - 1)), bits


def _runs(pixels: np.ndarray, raw: bytes, unit: int) -> list[tuple[int, int, int]]:
    """(pixel, length, back): runs of at least LEAST_RUN bytes that stood before, left to right, none over another. Sought where a word or a row of four begins."""
    n = len(raw)
    if n < 2 * LEAST_RUN:
        return []
    eights = np.ndarray((n + 1,), "<u8", raw + b"\0" * 8, 0, (1,))  # the eight bytes from each place on
    if unit == 1:
        starts = np.flatnonzero(np.frombuffer(raw, np.uint8, n - LEAST_RUN) <= 32) + 1
        if len(starts) < n >> 5:
            starts = np.arange(0, n - LEAST_RUN, 4)
    else:
        starts = np.arange(0, n - LEAST_RUN, unit)
    own = eights[starts]
    order = np.argsort(own, kind="stable")
    again = np.flatnonzero(own[order[1:]] == own[order[:-1]])
    if not len(again):
        return []
    here, there = starts[order[again + 1]], starts[order[again]]
    length, open_ = np.full(len(here), LEAST_RUN), np.arange(len(here))
    while len(open_):  # eight bytes at a time, as long as all are alike
        a, b = here[open_] + length[open_], there[open_] + length[open_]
        inside = a + 8 <= n
        open_, a, b = open_[inside], a[inside], b[inside]
        same = (eights[a] == eights[b]) & (length[open_] + 8 <= MOST_RUN * unit)
        open_ = open_[same]
        length[open_] += 8
    out, done = [], 0
    for k in np.argsort(here, kind="stable").tolist():
        at, m = int(here[k]), int(length[k])
        if at >= done:
            out.append((at // unit, min(m // unit, MOST_RUN), (at - int(there[k])) // unit))
            done = at + m
    return out


def _image(w: BitWriter, pixels: np.ndarray, width: int, top: bool, raw: bytes | None = None, unit: int = 1, cache_bits: int = 0) -> None:
    """Pixels as an entropy-coded image; raw: the bytes in which runs are sought, unit of them a pixel."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    runs = _runs(pixels, raw, unit) if raw is not None else []
    n, literal = len(pixels), np.ones(len(pixels), bool)
    for at, m, _ in runs:
        literal[at : at + m] = False
    at_runs, lengths, backs = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.empty(0, np.int64),) * 3
    start = literal.copy()
    start[at_runs] = True
    tokens = np.flatnonzero(start)
    own = pixels[tokens]
    green = (own >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    # channels of one value everywhere take a code of one symbol and no bits
    same = int(pixels[0]) & 0xFFFF00FF
    flat = bool((pixels & np.uint32(0xFFFF00FF) == np.uint32(same)).all())
    others = [None] * 3 if flat else [(own >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24)]
    lone = [same >> s & 255 if flat else int(x[0]) if (x == x[0]).all() else None for s, x in zip((16, 0, 24), others, strict=True)]
    is_run = ~literal[tokens]
    plain = ~is_run
    if cache_bits:
        cached, hit = [0] * (1 << cache_bits), np.zeros(n, bool)
        slot = ((np.uint64(0x1E35A7BD) * pixels.astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        for k, (x, s) in enumerate(zip(pixels.tolist(), slot.tolist(), strict=True)):
            hit[k] = cached[s] == x
            cached[s] = x
        by_cache = plain & hit[tokens]
        plain &= ~by_cache
        green[by_cache] = 280 + slot[tokens][by_cache]
    size = ALPHABETS[0] + (1 << cache_bits if cache_bits else 0)
    none = np.empty(0, np.int64)
    if runs:
        by_distance = _by_distance(width)
        l_sym, l_extra, l_bits = _prefixed(lengths)
        d_sym, d_extra, d_bits = _prefixed(np.array([by_distance.get(d, d + 120) for d in backs.tolist()], np.int64))
        green[is_run] = 256 + l_sym
    counts = [np.bincount(green, minlength=size), *(None if k is not None else np.bincount(x[plain], minlength=256) for k, x in zip(lone, others, strict=True)), np.bincount(d_sym, minlength=40) if runs else None]
    codes = []
    for c, k in zip(counts, (None, *lone, 0), strict=True):
        if c is None:
            w.values += [1, 0, int(k > 1), k]
            w.widths += [1, 1, 1, 8 if k > 1 else 1]
            codes.append((none, none))
            continue
        own_lengths = code_lengths(c)
        _put_code(w, own_lengths)
        codes.append((canonical(own_lengths), own_lengths if (own_lengths > 0).sum() > 1 else np.zeros_like(own_lengths)))
    wide = [k for k in (1, 2, 3) if codes[k][1].any()]
    fields = np.where(is_run, 4, np.where(plain, 1 + len(wide), 1))
    at = np.cumsum(fields) - fields
    values, widths = np.zeros(int(fields.sum()), np.int64), np.zeros(int(fields.sum()), np.int64)
    values[at], widths[at] = codes[0][0][green], codes[0][1][green]
    for place, k in enumerate(wide, 1):
        x = others[k - 1][plain]
        values[at[plain] + place], widths[at[plain] + place] = codes[k][0][x], codes[k][1][x]
    if runs:
        r = at[is_run]
        values[r + 1], widths[r + 1] = l_extra, l_bits
        values[r + 2], widths[r + 2] = codes[4][0][d_sym], codes[4][1][d_sym]
        values[r + 3], widths[r + 3] = d_extra, d_bits
    w.array(values, widths)


def _bits(x: np.ndarray) -> float:
    """What samples of a byte take in a code of their own counts."""
    n = np.bincount(x.ravel(), minlength=256)
    n = n[n > 0]
    return float((n * np.log2(len(x.ravel()) / n)).sum())


def _bits_of(counts: np.ndarray) -> np.ndarray:
    """The same of rows of counts."""
    total = counts.sum(axis=1, keepdims=True)
    return (counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1))).sum(axis=1)


def predictions(p: np.ndarray, width: int) -> np.ndarray:
    """modes x pixels x channels: what each of the 14 modes foretells of all pixels but those of the first row and column."""
    own = np.stack(_split(p), axis=1).reshape(-1, width, 4)
    h = own.shape[0]
    left, top, top_left = own[1:, :-1], own[:-1, 1:], own[:-1, :-1]
    after = np.concatenate([own[:-1, 2:], own[1:, :1]], axis=1)  # right of the last column stands the first of the next row
    half = lambda a, b: a + b >> 1
    held = lambda a: np.clip(a, 0, 255)
    mid = half(left, top)
    nearer = (np.abs(top - top_left).sum(axis=2) < np.abs(left - top_left).sum(axis=2))[..., None]
    black = np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)
    out = [black, left, top, after, top_left, half(half(left, after), top), half(left, top_left), mid, half(top_left, top), half(top, after), half(half(left, top_left), half(top, after)), np.where(nearer, left, top), held(left + top - top_left), held(mid + np.trunc((mid - top_left) / 2).astype(np.int64))]
    return np.stack(out).reshape(14, h - 1, width - 1, 4)


def _predicted_rest(p: np.ndarray, width: int, block: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(what is left of the pixels after the best mode of each block, the modes)."""
    own = np.stack(_split(p), axis=1).reshape(-1, width, 4)
    h = own.shape[0]
    rest = own.copy()
    rest[0, 0] -= (255, 0, 0, 0)
    rest[0, 1:] -= own[0, :-1]
    rest[1:, 0] -= own[:-1, 0]
    across, down = -(-width >> block), -(-h >> block)
    modes = np.zeros(across * down, np.int64)
    if h > 1:
        left = own[None, 1:, 1:] - predictions(p, width)
        cost = np.abs(_signed(left)).sum(axis=3)
        of_block = (np.arange(1, h)[:, None] >> block) * across + (np.arange(1, width)[None, :] >> block)
        total = np.stack([np.bincount(of_block.ravel(), c.ravel(), across * down) for c in cost])
        modes = total.argmin(axis=0)
        rest[1:, 1:] = np.take_along_axis(left, modes[of_block][None, :, :, None], 0)[0]
    return _join(*rest.reshape(-1, 4).T), modes


def _factor(x: np.ndarray, y: np.ndarray) -> int:
    """The multiple of x, in 32nds, that comes nearest to y; as a byte."""
    a, b = _signed(x).astype(np.float64), _signed(y).astype(np.float64)
    return int(np.clip(np.round(32 * (a * b).sum() / max((a * a).sum(), 1.0)), -128, 127)) & 255


_CHANNEL = np.tile(np.arange(4, dtype=np.uint16) * 256, GREY * ROWS // 4)


def _header(width: int, rows: int) -> BitWriter:
    w = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (rows - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    return w


def encode(payload: bytes) -> bytes:
    """Bytes (a positive multiple of 64, up to 4096 rows of them) as one image, in the form that takes the fewest bits by its samples' entropy."""
    rows, odd = divmod(len(payload), GREY)
    if odd or not 0 < rows <= ROWS:
        raise ValueError("whole rows are needed")
    x = np.frombuffer(payload, np.uint8)
    of_four = np.bincount(x + _CHANNEL[: len(x)], minlength=1024).reshape(4, 256)
    shades = np.flatnonzero(of_four.sum(axis=0))
    if 1 < len(shades) <= 16 and rows > 1:
        return _palette_image(x, shades, rows, payload)
    if rows > 3:
        table, four = x.reshape(rows, GREY), x.reshape(-1, 4)
        steps = np.bincount(np.r_[np.diff(table, axis=1).ravel(), (table[1:] - table[:-1]).ravel() + np.uint16(256), four[:, 1] - four[:, 0] + np.uint16(512), four[:, 2] - four[:, 0] + np.uint16(768)], minlength=1024).reshape(4, 256)
        plain, *packed, left, up, red, blue = _bits_of(np.concatenate([of_four.sum(axis=0)[None], of_four, steps])).tolist()
        less, packed = packed[0] + red + blue + packed[3], sum(packed)
        if min(left, up, packed, less) < 0.9 * plain:
            return _predicted_image(x, rows) if min(left, up) <= min(packed, less) else _packed_image(four, rows)
    w = _header(GREY, rows)
    w.put(1, 1)
    w.put(2, 2)  # grey less green: one channel is left
    w.put(0, 1)
    _image(w, x.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), GREY, True, payload, 1)
    return riff(w.bytes())


def _grey(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)


def _palette_image(x: np.ndarray, shades: np.ndarray, rows: int, payload: bytes) -> bytes:
    w = _header(GREY, rows)
    w.put(1, 1)
    w.put(3, 2)
    w.put(len(shades) - 1, 8)
    colours = _grey(shades)
    steps = [np.diff(c, prepend=0) for c in _split(colours)]
    _image(w, _join(*steps), len(shades), False)
    w.put(0, 1)
    pack = 3 if len(shades) <= 2 else 2 if len(shades) <= 4 else 1
    place = np.zeros(256, np.int64)
    place[shades] = np.arange(len(shades))
    index = place[x].reshape(rows, -1, 1 << pack)
    bundled = (index << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2).astype(np.uint8).ravel()
    _image(w, bundled.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), GREY >> pack, True, bundled.tobytes(), 1)
    return riff(w.bytes())


def _predicted_image(x: np.ndarray, rows: int) -> bytes:
    w, block = _header(GREY, rows), 4
    w.put(1, 1)
    w.put(2, 2)
    w.put(1, 1)
    w.put(0, 2)
    w.put(block - 2, 3)
    # of a grey less its green, green alone is left to foretell
    rest, modes = _predicted_rest(x.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), GREY, block)
    _image(w, modes.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), -(-GREY >> block), False)
    w.put(0, 1)
    _image(w, rest, GREY, True)
    return riff(w.bytes())


def _packed_image(four: np.ndarray, rows: int) -> bytes:
    """Green, red, blue, alpha of four bytes each; red and blue less green, or less what others foretell of them, where that takes fewer bits."""
    w = _header(PACKED, rows)
    pixels = _join(four[:, 3], four[:, 1], four[:, 0], four[:, 2])
    a, r, g, b = _split(pixels)
    green_red, green_blue = _factor(g, r), _factor(g, b)
    red_blue = _factor(r, b - (_signed(np.full_like(g, green_blue)) * _signed(g) >> 5))
    factors = np.full(-(-PACKED >> 4) * -(-rows >> 4), 0xFF000000 | red_blue << 16 | green_blue << 8 | green_red, np.uint32)
    forms = [pixels, _join(a, r - g, g, b - g), cross_colour(pixels, PACKED, rows, factors, 4, -1)]
    costs = [sum(_bits((p >> np.uint32(s) & np.uint32(255)).astype(np.uint8)) for s in (16, 0)) for p in forms]
    best = int(np.argmin(costs))
    pixels = forms[best]
    if best:
        w.put(1, 1)
        w.put(2 if best == 1 else 1, 2)
    if best == 2:
        w.put(2, 3)
        _image(w, factors, -(-PACKED >> 4), False)
    w.put(0, 1)
    distinct = len(np.unique(pixels))
    cache_bits = min(10, max(1, (distinct - 1).bit_length())) if 2 * distinct < len(pixels) else 0
    _image(w, pixels, PACKED, True, pixels.astype("<u4").tobytes(), 4, cache_bits)
    return riff(w.bytes())


def store(payload: bytes) -> bytes:
    """A payload as one image, or several one after another."""
    step = GREY * ROWS
    return b"".join(encode(payload[k : k + step]) for k in range(0, len(payload), step))


def read_back(media: bytes):
    """The pixel arrays of store()'s images."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield decode(media[at : at + size])
        at += size


def payload_of(pixels: np.ndarray) -> bytes:
    """The bytes that an image holds: its greens, or four of each pixel."""
    own = np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return own[:, 1].tobytes() if pixels.shape[1] == GREY else own[:, [1, 2, 0, 3]].tobytes()


def _store_batches(batches):
    for b in batches:
        media = [store(raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))) for raw in each(b.column(1))]
        sizes = [len(raw.as_buffer()) for raw in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as lossless WebP. Null text: an empty one, 64 zero bytes. No rows: no rows."""
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("raw")), _store_batches, "doc_id long, n_bytes long, media binary")


def features(payload: bytes) -> str:
    """Mean, share of zero samples, entropy in bits and the mean step between neighbours, of all samples."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};zero={n[0] / len(x):.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};step={step:.4f}"


def _digest_batches(batches):
    for b in batches:
        out = []
        for media in each(b.column(2)):
            payload = b"".join(map(payload_of, read_back(media)))
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", *names])


def media_digests(media: DataFrame) -> DataFrame:
    return arrow_map(media, _digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_lossless_webp(spark, sf_dir: str) -> DataFrame:
    """Every document stored as lossless WebP and read back."""
    return media_digests(with_media(load(spark, sf_dir, "documents")))
