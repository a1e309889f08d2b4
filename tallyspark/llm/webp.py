"""Lossless WebP media columns.

decode() reads any lossless WebP still image (VP8L): prefix codes with their code-length codes and meta images,
LZ77 back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. It
gives a pixel array of height x width x 4 (RGBA).

encode() writes a sample array with what pays by an estimate of its bits: a palette for few colours, else a predictor
(left or top) or subtract-green; back-references found by equal windows of four pixels; a colour cache; and prefix codes
by frequency. Where an image is too small to pay for codes of its own it takes STATIC codes, made by a rule from the
letters of prose; they stand in the file like any others. Nothing but the image decides, so equal texts give equal files.

decode() reads a main image by vector operations: at every bit of a stretch it looks up the token that would begin
there and where the next one would, follows that chain, then resolves copies by pointer doubling. Inner images, and
those with groups of codes, go through the general loop.

Defined cases: a null text is empty; an empty text is a row of spaces; rows that repeat stay rows; an empty table gives
an empty table; extra columns are dropped; a text of more than 768 MB raises ValueError.

A payload of bytes is stored as RGB samples, 64 pixels a row (a wider row where there are more than 16384 of them).
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 192
MAX_SIDE = 1 << 14
#: fixed values of the format: order of code-length codes, alphabet sizes, distance map of short back-references
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTHS, DISTANCES = 24, 40


def _short_distances() -> list[tuple[int, int]]:
    """The 120 neighbours of a pixel that codes 1 to 120 name, nearest first; by rule.

    Offsets (x, y) with y from 0 to 7 and x from -7 to 8 that lie before the pixel, by distance, then larger y first
    among equals, then x > 0 before x < 0.
    """
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    near.sort(key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
    return near[:120]


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.n, self.value, self.have = raw, 0, len(raw), 0, 0

    def need(self, k: int) -> None:
        while self.have < k:
            chunk = self.raw[self.at : self.at + 8]
            self.value |= int.from_bytes(chunk, "little") << self.have
            self.have += 64
            self.at += 8
            if self.at > self.n + 64:
                raise ValueError("the stream ends early")

    def read(self, k: int) -> int:
        if self.have < k:
            self.need(k)
        out = self.value & ((1 << k) - 1)
        self.value >>= k
        self.have -= k
        return out

    def position(self) -> int:
        return self.at * 8 - self.have


def reverse(code: int, k: int) -> int:
    return int(format(code, f"0{k}b")[::-1], 2) if k else 0


@functools.cache
def _reversed(k: int) -> np.ndarray:
    """The numbers of k bits, each with its bits in reverse."""
    out = np.zeros(1 << k, np.int64)
    for i in range(k):
        out |= (np.arange(1 << k) >> i & 1) << (k - 1 - i)
    return out


class Code:
    """A canonical prefix code. flat: the bits of all codewords where they are equal, with their symbols in order."""

    def __init__(self, lengths: list[int]):
        used = [(k, s) for s, k in enumerate(lengths) if k]
        self.only = used[0][1] if len(used) == 1 else None
        self.flat, self.symbols = None, np.zeros(0, np.int64)
        if not used:
            self.only = 0
        if self.only is not None:
            self.flat, self.symbols = 0, np.array([self.only])
            return
        self.top = max(k for k, _ in used)
        if sum(1 << (self.top - k) for k, _ in used) != 1 << self.top:
            raise ValueError("the prefix code isn't complete")
        if all(k == self.top for k, _ in used):
            self.flat, self.symbols = self.top, np.array([s for _, s in used])
        self.used = used
        self.table = self.wide = None

    def build(self) -> None:
        self.table = [None] * (1 << self.top)
        code, last = 0, 0
        for k, s in sorted(self.used):
            code <<= k - last
            last = k
            for fill in range(1 << (self.top - k)):
                self.table[reverse(code, k) | fill << k] = (k, s)
            code += 1

    def lookup(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The mask of the bits to look at, and for each value of them the codeword's length and symbol."""
        if self.only is not None:
            return 0, np.zeros(1, np.int64), np.array([self.only], np.int64)
        if self.wide is None:
            k, sym = np.array(sorted(self.used), np.int64).T
            times = 1 << (self.top - k)
            back = _reversed(self.top)
            self.wide = (1 << self.top) - 1, np.repeat(k, times)[back], np.repeat(sym, times)[back]
        return self.wide

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.build()
        bits.need(self.top)
        k, s = self.table[bits.value & ((1 << self.top) - 1)]
        bits.value >>= k
        bits.have -= k
        return s


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for i in range(bits.read(4) + 4):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    i, last = 0, 8
    while i < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            i += 1
            last = s or last
        else:
            n = (3 + bits.read(2)) if s == 16 else (3 + bits.read(3)) if s == 17 else (11 + bits.read(7))
            if i + n > size:
                raise ValueError("code lengths run over the alphabet")
            if s == 16:
                lengths[i : i + n] = [last] * n
            i += n
    return Code(lengths)


def copied(symbol: int, bits: Bits) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """width x height pixels as ARGB in uint32."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, shift, which = 1, 0, None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        which = read_image(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
        which = (which >> 8 & 0xFFFF).reshape(-1)
        groups = int(which.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    known = static_codes(bits) if main and groups == 1 and not cache_size else None
    if known:
        codes = [known]
    else:
        codes = [[read_code(bits, n) for n in (256 + LENGTHS + cache_size, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    if groups == 1 and not cache_size:
        quick = read_flat(bits, codes[0], width * height)
        if quick is not None:
            return quick
    if main and groups == 1 and codes[0][0].only is None:
        return read_tokens(bits, codes[0], width, height, cache_bits)
    return read_loop(bits, codes, width, height, cache_bits, shift, which)


def read_flat(bits: Bits, codes: list[Code], n: int) -> np.ndarray | None:
    """The pixels, if each channel's codewords have one length and none is a back-reference."""
    four = codes[:4]
    if any(c.flat is None for c in four) or four[0].symbols.max() > 255:
        return None
    widths = [c.flat for c in four]  # green, red, blue, alpha
    start, total = bits.position(), sum(widths) * n
    raw = np.frombuffer(bits.raw, np.uint8)
    if start + total > 8 * len(raw):
        raise ValueError("the stream ends early")
    out = np.zeros(n, np.uint32)
    planes = np.unpackbits(raw[start // 8 : -(-(start + total) // 8)], bitorder="little")[start % 8 : start % 8 + total].reshape(n, -1) if total else None
    at = 0
    for c, k, place in zip(four, widths, (8, 16, 0, 24), strict=True):
        if k:
            no = np.packbits(planes[:, at : at + k], axis=1)[:, 0] >> (8 - k)
            out |= c.symbols.astype(np.uint32)[no] << np.uint32(place)
            at += k
        else:
            out |= np.uint32(int(c.symbols[0]) << place)
    bits.at, bits.value, bits.have = (start + total) // 64 * 8, 0, 0
    bits.read((start + total) % 64)
    return out


#: bits that are looked at in one go, and those that the longest token may have
STRETCH, LONGEST = 1 << 18, 160


def taken(raw: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """k bits (32 at most) at each of the bit positions."""
    byte = at >> 3
    v = np.zeros(len(at), np.uint64)
    for i in range(5):
        v |= raw[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return (v >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << k) - 1)


def extra_bits(symbol: np.ndarray) -> np.ndarray:
    return np.maximum(symbol - 2, 0) >> 1


def numbers(symbol: np.ndarray, extra: np.ndarray, more: np.ndarray) -> np.ndarray:
    """copied() of many symbols, whose extra bits hold more."""
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + more) + 1


def read_tokens(bits: Bits, codes: list[Code], width: int, height: int, cache_bits: int) -> np.ndarray:
    """The pixels of a main image with one group of codes. Memory is bounded by the image and one stretch of bits."""
    n = width * height
    (mg, lg, sg), (mr, lr, sr), (mb, lb, sb), (ma, la, sa), (md, ld, sd) = (c.lookup() for c in codes)
    file = np.frombuffer(bits.raw, np.uint8)
    at, seen = bits.position(), 0
    sizes, values, kinds, gaps = [], [], [], []
    while seen < n:
        if at >= 8 * len(file):
            raise ValueError("the stream ends early")
        first = at >> 3
        raw = file[first : first + (STRETCH + LONGEST) // 8]
        limit = min(8 * len(raw), STRETCH)
        raw = np.concatenate([raw, np.zeros(LONGEST // 4 + 8, np.uint8)])
        three = raw[:-2].astype(np.uint32) | raw[1:-1].astype(np.uint32) << np.uint32(8) | raw[2:].astype(np.uint32) << np.uint32(16)
        window = (three.astype(np.int64)[:, None] >> np.arange(8)).reshape(-1)
        low = window & mg
        symbol = sg.take(low)
        after_green = np.arange(limit)
        after_green += lg.take(low[:limit])
        red = lr.take(low if mr == mg else window & mr)
        blue = red if lb is lr else lb.take(window & mb)
        to = after_green + red.take(after_green)
        to += blue.take(to)
        if ma:
            to += la.take(window.take(to) & ma)
        odd = np.flatnonzero(symbol[:limit] > 255)
        if len(odd):
            q = after_green[odd]
            copy = symbol[odd] < 256 + LENGTHS
            to[odd[~copy]] = q[~copy]
            q = q[copy] + extra_bits(symbol[odd[copy]] - 256)
            far = window[q] & md
            to[odd[copy]] = q + ld[far] + extra_bits(sd[far])
        chain, step, p = [], memoryview(to), at - 8 * first
        while p < limit:
            chain.append(p)
            p = step[p]
        at = 8 * first + p
        way = np.array(chain, np.int64)
        kind, q = symbol.take(way), after_green.take(way)
        size, gap = np.ones(len(way), np.int64), np.zeros(len(way), np.int64)
        # a token that isn't a literal gets a value, too, which nothing reads
        v = kind << 8 | sr.take(window.take(q) & mr) << 16
        ql = q + red.take(q)
        v |= sb.take(window.take(ql) & mb)
        if ma:
            ql = ql + blue.take(ql)
            v |= sa.take(window.take(ql) & ma) << 24
        else:
            v |= int(sa[0]) << 24
        value = (v & 0xFFFFFFFF).astype(np.uint32)
        copy = np.flatnonzero((kind > 255) & (kind < 256 + LENGTHS))
        if len(copy):
            qc, k = q[copy], kind[copy] - 256
            ex = extra_bits(k)
            size[copy] = numbers(k, ex, taken(raw, qc, ex))
            qc = qc + ex
            far = window[qc] & md
            qc, k = qc + ld[far], sd[far]
            ex = extra_bits(k)
            d = numbers(k, ex, taken(raw, qc, ex))
            gap[copy] = np.where(d > 120, d - 120, np.maximum(1, _NEAR_X[np.minimum(d, 120) - 1] + _NEAR_Y[np.minimum(d, 120) - 1] * width))
        seen += int(size.sum())
        sizes.append(size)
        values.append(value)
        kinds.append(kind)
        gaps.append(gap)
    size, value, kind, gap = (np.concatenate(x) for x in (sizes, values, kinds, gaps))
    last = int(np.searchsorted(np.cumsum(size), n)) + 1
    size, value, kind, gap = size[:last], value[:last], kind[:last], gap[:last]
    if int(size.sum()) != n:
        raise ValueError("a back-reference leaves the image")
    if not gap.any() and not cache_bits:
        return value
    start = np.cumsum(size) - size
    if (gap > start).any():
        raise ValueError("a back-reference leaves the image")
    if cache_bits:
        return with_cache(size, value, kind, gap, cache_bits)
    src = np.arange(n) - np.repeat(gap, size)
    while True:
        up = src[src]
        if (up == src).all():
            return np.repeat(value, size)[src]
        src = up


def with_cache(size, value, kind, gap, cache_bits: int) -> np.ndarray:
    """The pixels of tokens, in turn, as each changes the colour cache."""
    shift, cache, out = 32 - cache_bits, [0] * (1 << cache_bits), []
    slots = slot(value, cache_bits).tolist()
    for k, v, s, g, m in zip(kind.tolist(), value.tolist(), slots, gap.tolist(), size.tolist(), strict=True):
        if k < 256:
            cache[s] = v
            out.append(v)
        elif g:
            for _ in range(m):
                v = out[-g]
                out.append(v)
                cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = v
        else:
            out.append(cache[k - 256 - LENGTHS])
    return np.array(out, np.uint32)


def slot(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    """Where the colour cache keeps each pixel."""
    return (argb.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)


def read_loop(bits: Bits, codes, width: int, height: int, cache_bits: int, shift: int, which) -> np.ndarray:
    n = width * height
    out = [0] * n
    cache = [0] * (1 << cache_bits) if cache_bits else None
    near = _NEAR
    across = (width + (1 << shift) - 1) >> shift if which is not None else 0
    i = 0
    green, red, blue, alpha, far = codes[0]
    done = 0  # pixels already in the cache

    def remember(upto: int) -> None:
        nonlocal done
        while done < upto:
            cache[(out[done] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = out[done]
            done += 1

    while i < n:
        if which is not None:
            green, red, blue, alpha, far = codes[which[(i // width >> shift) * across + (i % width >> shift)]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 256 + LENGTHS:
            k = copied(s - 256, bits)
            d = copied(far.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                x, y = near[d - 1]
                d = max(1, x + y * width)
            if d > i or i + k > n:
                raise ValueError("a back-reference leaves the image")
            for j in range(i, i + k):
                out[j] = out[j - d]
            i += k
        else:
            if cache is None:
                raise ValueError("no colour cache")
            remember(i)
            out[i] = cache[s - 256 - LENGTHS]
            i += 1
    return np.array(out, np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """n x 4 in the order A, R, G, B, as int32."""
    return np.stack([argb >> k & 255 for k in (24, 16, 8, 0)], -1).astype(np.int32)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _mean(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, top_left, top_right):
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode == 6:
        return _mean(left, top_left)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(top_left, top)
    if mode == 9:
        return _mean(top, top_right)
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    if mode == 11:
        near_left = np.abs(top - top_left).sum()
        near_top = np.abs(left - top_left).sum()
        return left if near_left < near_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = _mean(left, top)
        half = (m - top_left).astype(np.int64)
        return np.clip(m + np.trunc(half / 2).astype(np.int64), 0, 255)
    raise ValueError("no such predictor")


def undo_predictor(argb: np.ndarray, width: int, height: int, size: int, modes: np.ndarray) -> np.ndarray:
    p = channels(argb).reshape(height, width, 4)
    across = (width + (1 << size) - 1) >> size
    black = np.array([255, 0, 0, 0])
    p[0, 0] = (p[0, 0] + black) & 255
    # the first row adds its left neighbour, the first column the one above
    p[0, 1:] = (np.cumsum(p[0], 0) & 255)[1:]
    used = set((modes >> 8 & 15).tolist())
    if used == {2} or height == 1:
        return joined(np.cumsum(p, 0).reshape(-1, 4))
    if used == {1}:
        p[:, 0] = np.cumsum(p[:, 0], 0)
        p[1:] = np.cumsum(p[1:], 1)
        return joined(p.reshape(-1, 4))
    for y in range(1, height):
        p[y, 0] = (p[y, 0] + p[y - 1, 0]) & 255
        row, up = p[y], p[y - 1]
        for x in range(1, width):
            right = up[x + 1] if x + 1 < width else row[0]
            mode = int(modes[(y >> size) * across + (x >> size)]) >> 8 & 15
            row[x] = (row[x] + predicted(mode, row[x - 1], up[x], up[x - 1], right)) & 255
    return joined(p.reshape(-1, 4))


def undo_cross_colour(argb: np.ndarray, width: int, height: int, size: int, blocks: np.ndarray) -> np.ndarray:
    p = channels(argb).reshape(height, width, 4)
    across = (width + (1 << size) - 1) >> size
    y, x = np.mgrid[:height, :width]
    m = blocks[(y >> size) * across + (x >> size)]
    signed = lambda v: ((v & 255).astype(np.int32) ^ 128) - 128
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    green, red, blue = p[..., 2], p[..., 1], p[..., 3]
    red = (red + delta(m, green)) & 255
    blue = (blue + delta(m >> 8, green) + delta(m >> 16, red)) & 255
    return joined(np.stack([p[..., 0], red, green, blue], -1)).reshape(-1)


def undo_green(argb: np.ndarray) -> np.ndarray:
    p = channels(argb)
    p[:, 1] += p[:, 2]
    p[:, 3] += p[:, 2]
    return joined(p)


def undo_palette(argb: np.ndarray, packed: int, width: int, height: int, bundle: int, colours: np.ndarray) -> np.ndarray:
    no = (argb >> 8 & 255).astype(np.int64)
    if bundle:
        each = 8 >> bundle
        no = (no.reshape(height, packed, 1) >> (np.arange(1 << bundle) * each)) & ((1 << each) - 1)
        no = no.reshape(height, -1)[:, :width].reshape(-1)
    return np.where(no < len(colours), colours[np.minimum(no, len(colours) - 1)], 0).astype(np.uint32)


def decode(raw: bytes) -> np.ndarray:
    """height x width x 4 samples (red, green, blue, alpha)."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(raw) and raw[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(raw[at + 4 : at + 8], "little") + 1) // 2 * 2
    if raw[at : at + 4] != b"VP8L":
        raise ValueError("no lossless image in the file")
    bits = Bits(raw[at + 8 : at + 8 + int.from_bytes(raw[at + 4 : at + 8], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    todo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            size = bits.read(3) + 2
            block = read_image(bits, (wide + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            todo.append((undo_predictor if kind == 0 else undo_cross_colour, wide, height, size, block))
        elif kind == 2:
            todo.append((undo_green,))
        else:
            n = bits.read(8) + 1
            colours = joined(np.cumsum(channels(read_image(bits, n, 1, False)), 0))
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            packed = (wide + (1 << bundle) - 1) >> bundle
            todo.append((undo_palette, packed, wide, height, bundle, colours))
            wide = packed
    argb = read_image(bits, wide, height, True)
    for undo, *rest in reversed(todo):
        argb = undo(argb, *rest)
    return np.stack([argb >> k & 255 for k in (16, 8, 0, 24)], -1).astype(np.uint8).reshape(height, width, 4)


_NEAR = _short_distances()
_NEAR_X, _NEAR_Y = np.array(_NEAR, np.int64).T


class Writer:
    """Bits least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, k: int) -> None:
        self.value |= v << self.n
        self.n += k


def code_lengths(count: np.ndarray, limit: int) -> np.ndarray:
    """The codeword lengths of a Huffman code, of limit bits at most; rare symbols count for more where it is deeper."""
    used = np.flatnonzero(count)
    out = np.zeros(len(count), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight, least = count[used], 1
    while True:
        w = np.maximum(weight, least)
        order = np.argsort(w, kind="stable")
        leaves, n = w[order].tolist(), len(used)
        inner, parent = [], [0] * (2 * n - 1)
        a = b = 0
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if a < n and (b >= len(inner) or leaves[a] <= inner[b]):
                    total += leaves[a]
                    parent[a] = node
                    a += 1
                else:
                    total += inner[b]
                    parent[n + b] = node
                    b += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= limit:
            out[used[order]] = depth[:n]
            return out
        least = max(2 * least, int(weight.sum()) >> limit)


def codewords(lengths: np.ndarray) -> np.ndarray:
    """The canonical codewords, as they stand in the stream (first bit lowest)."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return out
    k = lengths[used]
    order = np.lexsort((used, k))
    top = int(k.max())
    share = 1 << (top - k[order])
    code = (np.cumsum(share) - share) >> (top - k[order])
    back = _reversed(top)
    out[used[order]] = back[code] >> (top - k[order])
    return out


DEEPEST = 12


def put_code(w: Writer, lengths: np.ndarray) -> np.ndarray:
    """Write a code; gives the bits that its symbols take (none where there is one symbol only)."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 2 and (not used or used[0] < 256):
        w.put(1, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(used[0] if used else 0, 8)
        return np.zeros(len(lengths), np.int64)
    words, last = [], -1
    for s in [*used, len(lengths)]:
        gap = s - last - 1
        while gap >= 11:
            m = min(138, gap)
            words.append((18, m - 11, 7))
            gap -= m
        if gap >= 3:
            words.append((17, gap - 3, 3))
            gap = 0
        words += [(0, 0, 0)] * gap
        if s < len(lengths):
            words.append((int(lengths[s]), 0, 0))
        last = s
    own = code_lengths(np.bincount([x[0] for x in words], minlength=19), 7)
    code = codewords(own).tolist()
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(int(own[s]), 3)
    w.put(0, 1)  # all lengths follow
    bare = np.count_nonzero(own) < 2
    size = own.tolist()
    for s, extra, k in words:
        if not bare:
            w.put(code[s], size[s])
        w.put(extra, k)
    return lengths if len(used) > 1 else np.zeros(len(lengths), np.int64)


def copies(px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of back-references, in order and apart.

    Each pixel looks at the last earlier one where the same four pixels begin; stretches with one distance are a copy.
    """
    none = np.zeros(0, np.int64)
    if len(px) < 5:
        return none, none, none
    p = px.astype(np.uint64)
    key = ((p[:-3] * np.uint64(0x9E3779B97F4A7C15) + p[1:-2]) * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:-1]) * np.uint64(0x165667B19E3779F9) + p[3:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return none, none, none
    gap = np.zeros(len(key), np.int64)
    gap[order[same + 1]] = order[same + 1] - order[same]
    edge = np.flatnonzero(np.diff(gap)) + 1
    start = np.concatenate([[0], edge])
    end = np.concatenate([edge, [len(key)]]) + 3
    real = gap[start] > 0
    start, end = start[real], end[real]
    d = gap[start]
    start[1:] = np.maximum(start[1:], end[:-1])
    long = end - start >= 4
    start, end, d = start[long], end[long], d[long]
    # a hash may agree by chance: what isn't equal isn't copied
    inside = np.repeat(start - np.cumsum(end - start) + (end - start), end - start) + np.arange(int((end - start).sum()))
    wrong = px[inside] != px[inside - np.repeat(d, end - start)]
    if wrong.any():
        bad = np.unique(np.repeat(np.arange(len(start)), end - start)[wrong])
        start, end, d = (np.delete(x, bad) for x in (start, end, d))
    parts = -(-(end - start) // 4096)
    no = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + 4096 * no
    return begin, np.minimum(np.repeat(end, parts) - begin, 4096), np.repeat(d, parts)


def prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and extra bits of lengths or distances."""
    n = v - 1
    high = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    k = np.where(n < 4, 0, high - 1)
    return np.where(n < 4, n, 2 * high + (n >> np.maximum(k, 0) & 1)), k, np.where(n < 4, 0, n & ((1 << k) - 1))


def bits_of(count: np.ndarray) -> float:
    """Bits that symbols with these counts take by their entropy."""
    c = count[count > 0]
    return float((c * np.log2(c.sum() / c)).sum())


CACHE_BITS = 8
#: tokens of an image that has use for a colour cache; about the bits that codes of its own take, and what they must
#: spare, as making and reading them takes time
CACHED, OWN_HEAD, SPARED = 4096, 700, 6000
#: fixed values: the commonest bytes of prose, in falling order; each next one counts for so much less
PROSE, FALL = b" eantirsoludchmgpfvbwkyzq.,jx", 0.87


@functools.cache
def static_lengths() -> list[np.ndarray]:
    letter = np.zeros(256, np.int64)
    letter[[10, *range(32, 127), *range(128, 192), 195]] = 4
    letter[list(PROSE)] = [max(2, int(3000 * FALL**i)) for i in range(len(PROSE))]
    copied_ = np.full(LENGTHS, 40)
    return [code_lengths(x, DEEPEST) for x in (np.concatenate([letter, copied_]), letter, letter, np.arange(256) == 255, np.ones(DISTANCES, np.int64))]


@functools.cache
def static_head() -> tuple[int, int, tuple]:
    """The static codes as they stand in a stream: bits, their number, and bits a symbol."""
    w = Writer()
    k = tuple(put_code(w, x) for x in static_lengths())
    return w.value, w.n, k


@functools.cache
def _static_codes() -> tuple:
    lengths = static_lengths()
    green, letter, alpha, far = (Code(x.tolist()) for x in (lengths[0], lengths[1], lengths[3], lengths[4]))
    return green, letter, letter, alpha, far


def static_codes(bits: Bits) -> list[Code] | None:
    """The static codes, if they stand next in the stream (which is then behind them)."""
    value, n, _ = static_head()
    if (bits.n - bits.at) * 8 + bits.have < n:
        return None
    bits.need(n)
    if bits.value & ((1 << n) - 1) != value:
        return None
    bits.read(n)
    return list(_static_codes())


def put_image(w: Writer, px: np.ndarray, main: bool) -> np.ndarray:
    """Write cache, codes (to w) and pixels; gives the pixels' bits."""
    start, size, gap = copies(px)
    literal = np.ones(len(px), bool)
    if len(start):
        literal[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = False
    begins = literal.copy()
    begins[start] = True
    at = np.flatnonzero(begins)
    p = px[at].astype(np.int64)
    green, red, blue, alpha = p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24
    plain = literal[at]
    copy = np.flatnonzero(~plain)
    len_sym, len_k, len_x = prefixed(size)
    far_sym, far_k, far_x = prefixed(gap + 120)
    green[copy] = 256 + len_sym
    hits = np.zeros(0, np.int64)
    if main and len(at) > CACHED:
        where = slot(px, CACHE_BITS)
        order = np.argsort(where, kind="stable")
        again = np.zeros(len(px), bool)
        again[order[1:]] = (where[order[1:]] == where[order[:-1]]) & (px[order[1:]] == px[order[:-1]])
        hits = np.flatnonzero(again[at] & plain)
        # a hit spares some four bits, and the longer code costs three a slot
        if 4 * len(hits) < 3 << CACHE_BITS:
            hits = hits[:0]
        else:
            green[hits] = 256 + LENGTHS + where[at[hits]].astype(np.int64)
            plain = plain.copy()
            plain[hits] = False
    cached = len(hits) > 0
    counts = [np.bincount(green, minlength=256 + LENGTHS + ((1 << CACHE_BITS) if cached else 0))]
    counts += [np.bincount(x[plain], minlength=256) for x in (red, blue, alpha)] + [np.bincount(far_sym, minlength=DISTANCES)]
    static = False
    if main and not cached and counts[3][255] == counts[3].sum():
        _, head, fixed = static_head()
        if not any(c[k == 0].any() for c, k in zip(counts[:3], fixed, strict=False)):
            own = sum(bits_of(c) for c in counts if c.any())
            static = sum(int(c @ k) for c, k in zip(counts, fixed, strict=True)) + head < own + OWN_HEAD + SPARED
    w.put(1 | CACHE_BITS << 1 if cached else 0, 5 if cached else 1)
    if main:
        w.put(0, 1)  # one group of codes
    if static:
        lengths = static_lengths()
        value, n, bits = static_head()
        w.put(value, n)
    else:
        lengths = [code_lengths(c, DEEPEST) for c in counts]
        bits = [put_code(w, k) for k in lengths]
    words = [_static_words()[i] if static else codewords(k) for i, k in enumerate(lengths)]
    # each token is one number of up to 64 bits
    n = bits[0][green]
    token = words[0][green]
    for sym, k, word in ((red, bits[1], words[1]), (blue, bits[2], words[2]), (alpha, bits[3], words[3])):
        if k.any():
            token |= word.take(sym) * plain << n.view(np.uint64)
            n = n + k.take(sym) * plain
    if len(copy):
        more, k = token[copy], n[copy]
        for v, width in ((len_x, len_k), (words[4][far_sym], bits[4][far_sym]), (far_x, far_k)):
            more |= v.astype(np.uint64) << k.astype(np.uint64)
            k = k + width
        token[copy], n[copy] = more, k
    # the low bit of each token, shifted by its place in it
    total = int(n.sum())
    inside = np.arange(total)
    inside -= np.repeat(np.cumsum(n) - n, n)
    out = np.repeat(token, n)
    out >>= inside.view(np.uint64)
    return out.astype(np.uint8) & np.uint8(1)


@functools.cache
def _static_words() -> tuple:
    return tuple(codewords(k) for k in static_lengths())


def put_bits(w: Writer, px: np.ndarray) -> None:
    """An inner image, all of it to w."""
    for b in put_image(w, px, False).tolist():
        w.put(b, 1)


def transformed(w: Writer, rgb: np.ndarray) -> np.ndarray:
    """Write the transforms that pay, and give the pixels that are left."""
    height, width = rgb.shape[:2]
    c = rgb.astype(np.uint8)
    argb = joined(np.concatenate([np.full((height, width, 1), 255, np.uint8), c], -1).reshape(-1, 4))
    k = len(set(argb[:64].tolist()))
    colours = np.unique(argb) if k <= 16 else argb[:0]
    k = max(k, len(colours))
    if k <= 16 and 4 * k < height * width:
        bundle = 3 if k <= 2 else 2 if k <= 4 else 1
        w.put(1 | 3 << 1, 3)
        w.put(k - 1, 8)
        listed = channels(colours)
        put_bits(w, joined(np.diff(listed, axis=0, prepend=0)))
        each, wide = 8 >> bundle, -(-width // (1 << bundle))
        no = np.zeros((height, wide << bundle), np.int64)
        no[:, :width] = np.searchsorted(colours, argb).reshape(height, width)
        green = (no.reshape(height, wide, 1 << bundle) << (np.arange(1 << bundle) * each)).sum(-1)
        return (np.uint32(255 << 24) | green.astype(np.uint32).reshape(-1) << np.uint32(8)).astype(np.uint32)
    # a difference pays only where neighbours or channels are often equal
    alike = [np.count_nonzero(c[:, 1:] == c[:, :-1]), np.count_nonzero(c[1:] == c[:-1]), 1.5 * np.count_nonzero(c[..., [0, 2]] == c[..., 1:2])]
    if max(alike) < 0.2 * c.size:
        return argb
    # samples as they are, less green, less the left and less the upper neighbour
    left, top = c.copy(), c.copy()
    left[:, 1:] -= c[:, :-1]
    left[1:, 0] -= c[:-1, 0]
    top[1:] -= c[:-1]
    top[0, 1:] -= c[0, :-1]
    green = c.copy()
    green[..., [0, 2]] -= c[..., 1:2]
    ways = (c, green, left, top)
    count = np.bincount((np.stack(ways).reshape(4, -1) + (256 * np.arange(4))[:, None]).reshape(-1), minlength=1024).reshape(4, 256)
    cost = (c.size * np.log2(c.size) - (count * np.log2(np.maximum(count, 1))).sum(1)).tolist()
    best = int(np.argmin(cost))
    if cost[best] > 0.9 * cost[0] - 200:
        return argb
    alpha = np.full((height, width, 1), 255, np.uint8)
    if best == 1:
        w.put(1 | 2 << 1, 3)
    else:
        alpha[:] = 0
        alpha[0, 0] = 0
        w.put(1 | 0 << 1 | 7 << 3, 6)
        blocks = -(-width // 512) * -(-height // 512)
        put_bits(w, np.full(blocks, 255 << 24 | (best - 1) << 8, np.uint32))
    return joined(np.concatenate([alpha, ways[best]], -1).reshape(-1, 4))


def encode(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of height x width x 3 samples."""
    height, width = rgb.shape[:2]
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    px = transformed(w, rgb)
    w.put(0, 1)  # no more transforms
    body = put_image(w, px, True)
    head = np.unpackbits(np.frombuffer(w.value.to_bytes(-(-w.n // 8), "little"), np.uint8), bitorder="little")[: w.n]
    data = np.packbits(np.concatenate([head, body]), bitorder="little").tobytes()
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def payload_of(raw: bytes) -> bytes:
    """raw with spaces up to a positive multiple of ROW bytes."""
    return raw + b" " * (ROW - len(raw) if len(raw) < ROW else -len(raw) % ROW)


def to_media(payload: bytes) -> bytes:
    """The payload as an image of 64 pixels a row. Rows get wider, and the last is filled with zeros, beyond 16384 rows."""
    rows = len(payload) // ROW
    wide = -(-rows // MAX_SIDE)
    if 64 * wide > MAX_SIDE:
        raise ValueError("a payload of more than 768 MB needs more than one image")
    high = -(-rows // wide)
    a = np.frombuffer(payload + b"\0" * (high * wide * ROW - len(payload)), np.uint8)
    return encode(a.reshape(high, 64 * wide, 3))


def from_media(media: bytes, size: int) -> tuple[bytes, tuple[int, int]]:
    """The payload of `size` bytes, and the image's height and width."""
    p = decode(media)
    return p[:, :, :3].tobytes()[:size], p.shape[:2]


STORED = "doc_id long, n_bytes long, payload_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """STORED: each text (null: empty) as a media column. Ids keep their rows; nothing is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                full = [payload_of(x) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([len(x) for x in full], pa.int64()), pa.array([to_media(x) for x in full], pa.binary())],
                    names=[x.split()[0] for x in STORED.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, STORED)


def read(stored: DataFrame) -> DataFrame:
    """READ: the media decoded, with checksums of the payload and of the stored form, and features of the pixels."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for size, media in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    payload, (high, wide) = from_media(media, size)
                    out.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, high, wide)))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names=[x.split()[0] for x in READ.split(", ")]
                )

    return stored.mapInArrow(rows, READ)


def feature(payload: bytes, high: int, wide: int) -> str:
    """Size, mean, deviation and entropy of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    total, v = int(n.sum()), np.arange(256)
    mean = float((n * v).sum() / total)
    dev = float(np.sqrt((n * (v - mean) ** 2).sum() / total))
    share = n[n > 0] / total
    return f"{wide}x{high};mean={mean:.3f};dev={dev:.3f};bits={float(-(share * np.log2(share)).sum()):.3f}"
