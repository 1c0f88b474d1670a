"""Media columns: lossless WebP written and read in Spark tasks, with numpy.

The decoder reads whole VP8L streams: simple and normal prefix codes, several code groups, back-references, the colour
cache, and it inverts the predictor, cross-colour, subtract-green and palette transforms. Stretches of literal pixels under
one code group are decoded at once: the code at every bit place is looked up for the whole stretch, and only the chain of
places from pixel to pixel is walked.

The encoder writes RGB samples under a fixed prefix code made for text bytes, with runs of one pixel as back-references.
A payload is stored as rows of 192 pixels; a payload too tall for one image gets wider rows, its length stands in the file.
:func:`decode` gives the pixel arrays of any lossless files; features and digests are computed from these arrays.

Defined cases: a null text counts as empty (one block of padding); equal texts give equal files; a damaged file raises; a null
id stays null; repeated rows each give a row; an empty table gives none; other columns are ignored. A payload of more bytes than
the largest picture of the format has samples (16,384 by 16,384 pixels, some 800 MB) raises.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.llm.common import Settled, small_batches

#: Samples of a block; the padding byte; pixels of a row; the largest side of an image.
BLOCK, PAD, ROW, SIDE = 576, 255, 192, 16383
#: Fixed values of the format: the order in which lengths of the length code are written.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) of the short distance codes, y rows up and x pixels to the left.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Fixed value of the format: the multiplier of the colour cache.
CACHE_HASH = 0x1E35A7BD
MOST_BITS = 15
#: Bits that a stretch of literals looks at together.
STRETCH = 1 << 20
#: A length that no code has, for places where no literal starts.
STOP = 255
_EIGHT = np.arange(8)


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = np.frombuffer(data + b"\0" * 48, np.uint8), at, 8 * len(data)
        self.raw = data + b"\0" * 48

    def read(self, n: int) -> int:
        i = self.at >> 3
        v = int.from_bytes(self.raw[i : i + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return v & ((1 << n) - 1)

    def peek(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.raw[i : i + 4], "little") >> (self.at & 7)) & 0x7FFF


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed for little-endian reading."""
    out, code = np.zeros(len(lengths), np.uint32), 0
    for n in range(1, MOST_BITS + 1):
        for s in np.flatnonzero(lengths == n).tolist():
            out[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _table(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each value of the next 15 bits; a single symbol takes no bits."""
    n = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(n)
    symbols, bits = np.zeros(1 << MOST_BITS, np.int32), np.zeros(1 << MOST_BITS, np.int32)
    if len(used) == 1:
        symbols[:] = used[0]
        return symbols, bits
    if sum(1 << (MOST_BITS - int(n[s])) for s in used) != 1 << MOST_BITS:
        raise ValueError("a prefix code isn't complete")
    codes = _codes(n)
    for s in used.tolist():
        at = slice(int(codes[s]), None, 1 << int(n[s]))
        symbols[at], bits[at] = s, n[s]
    return symbols, bits


def _read_code(bits: Bits, size: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _table(lengths.tobytes())
    of = np.zeros(19, np.uint8)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of[k] = bits.read(3)
    symbols, sizes = _table(of.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left > 0:
        left -= 1
        w = bits.peek()
        bits.at += int(sizes[w])
        s = int(symbols[w])
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + n > size:
            raise ValueError("code lengths run over")
        lengths[at : at + n] = last if s == 16 else 0
        at += n
    if not lengths.any():
        lengths[0] = 1
    return _table(lengths.tobytes())


#: Code groups read lately, as (bits, their value, sizes, codes): images of one writer share theirs.
_recent: list[tuple[int, int, tuple[int, ...], list]] = []


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list:
    """The prefix codes of a group; equal descriptions are parsed once."""
    for n, value, of, codes in _recent:
        if of == sizes and bits.at + n <= bits.end:
            i = bits.at >> 3
            if (int.from_bytes(bits.raw[i : i + (n >> 3) + 2], "little") >> (bits.at & 7)) & ((1 << n) - 1) == value:
                bits.at += n
                return codes
    start = bits.at
    codes: list = [_read_code(bits, k) for k in sizes]
    lengths = [c[1].astype(np.uint8) for c in codes[:4]]
    lengths[0] = np.where(codes[0][0] >= 256, np.uint8(STOP), lengths[0])
    codes.append((lengths, not lengths[3].any()))
    n, i = bits.at - start, start >> 3
    _recent.insert(0, (n, (int.from_bytes(bits.raw[i : i + (n >> 3) + 2], "little") >> (start & 7)) & ((1 << n) - 1), sizes, codes))
    del _recent[8:]
    return codes


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _literals(bits: Bits, group: list, out: np.ndarray, at: int) -> int:
    """Decodes literal pixels from ``at`` on until another symbol comes or the image is full; returns the place."""
    green, red, blue, alpha = group[:4]
    sizes, flat_alpha = group[5]
    while at < len(out):
        first = bits.at >> 3
        part = bits.data[first : first + (STRETCH >> 3) + 32].astype(np.intp)
        if len(part) < 12:
            part = np.pad(part, (0, 12 - len(part)))
        v = part[:-2] | (part[1:-1] << 8) | (part[2:] << 16)
        window = ((v[:, None] >> _EIGHT) & 0x7FFF).ravel()
        at_green = sizes[0].take(window).tobytes()
        at_red = sizes[1].take(window).tobytes()
        at_blue = at_red if blue is red else sizes[2].take(window).tobytes()
        at_alpha = b"" if flat_alpha else sizes[3].take(window).tobytes()
        p, limit, chain, n = bits.at & 7, len(window) - 80, [], 0
        keep = chain.append
        for _ in range(len(out) - at):
            n = at_green[p]
            if n == STOP or p >= limit:
                break
            keep(p)
            p += n
            p += at_red[p]
            p += at_blue[p]
            if at_alpha:
                p += at_alpha[p]
        if chain:
            place = np.array(chain, np.intp)
            w = window[place]
            pixels = green[0][w].astype(np.uint32) << np.uint32(8)
            place += sizes[0][w]
            for code, size, shift in ((red, sizes[1], 16), (blue, sizes[2], 0), (alpha, sizes[3], 24)):
                w = window[place]
                pixels |= code[0][w].astype(np.uint32) << np.uint32(shift)
                place += size[w]
            out[at : at + len(chain)] = pixels
            at += len(chain)
        bits.at = 8 * first + p
        if bits.at > bits.end:
            raise ValueError("the image ends early")
        if at < len(out) and n == STOP:
            break
    return at


def _entropy_coded(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB words."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    group_of, groups, block = None, 1, 0
    if main and bits.read(1):
        block = 2 + bits.read(3)
        across = (width + (1 << block) - 1) >> block
        down = (height + (1 << block) - 1) >> block
        meta = _entropy_coded(bits, across, down, False)
        group_of = ((meta >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64).reshape(down, across)
        groups = int(group_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [_read_codes(bits, (256 + 24 + cache_size, 256, 256, 256, 40)) for _ in range(groups)]
    out = np.zeros(width * height, np.uint32)
    cache, filled = np.zeros(max(1, cache_size), np.uint32), 0
    at, simple = 0, groups == 1 and not cache_size

    def one(code: tuple) -> int:
        w = bits.peek()
        bits.at += int(code[1][w])
        if bits.at > bits.end:
            raise ValueError("the image ends early")
        return int(code[0][w])

    while at < len(out):
        group = codes[int(group_of[(at // width) >> block, (at % width) >> block]) if group_of is not None else 0]
        if simple:
            at = _literals(bits, group, out, at)
            if at == len(out):
                break
        s = one(group[0])
        if s < 256:
            r, b, a = one(group[1]), one(group[2]), one(group[3])
            out[at] = (a << 24) | (r << 16) | (s << 8) | b
            at += 1
        elif s < 280:
            n = _value(bits, s - 256)
            d = _value(bits, one(group[4]))
            d = d - 120 if d > 120 else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)
            if d > at or at + n > len(out):
                raise ValueError("a back-reference points outside")
            while n > 0:  # what is copied may reach into itself
                k = min(n, d)
                out[at : at + k] = out[at - d : at - d + k]
                at, n = at + k, n - k
        else:
            while filled < at:  # colours enter the cache in order, just before it is asked
                cache[(int(out[filled]) * CACHE_HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = out[filled]
                filled += 1
            out[at] = cache[s - 280]
            at += 1
    return out


def _channels(x: np.ndarray) -> np.ndarray:
    """(..., 4) channels of ARGB words: blue, green, red, alpha."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(*x.shape, 4)


def _predicted(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, top_left, strict=True)]
    mean = half(left, top)
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean, top_left, strict=True)]


#: Predictor modes that don't look at the pixel to the left, which only comes with the same row.
_FROM_ABOVE = {
    0: lambda above, left, right: (0, 0, 0, 255), 2: lambda above, left, right: above, 3: lambda above, left, right: right, 4: lambda above, left, right: left,
    8: lambda above, left, right: (left.astype(np.uint16) + above) >> 1, 9: lambda above, left, right: (above.astype(np.uint16) + right) >> 1,
}


def _undo_predictor(x: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Adds predictions row by row; inside a row a block of one mode at a time, as arrays where the mode allows it."""
    height, width = x.shape
    modes = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    ch = _channels(x).copy()
    ch[0, 0, 3] = (int(ch[0, 0, 3]) + 255) & 255
    ch[0] = np.add.accumulate(ch[0], axis=0, dtype=np.uint8)  # the first row goes by the left neighbour
    for y in range(1, height):
        up, row = ch[y - 1], ch[y]
        row[0] += up[0]
        right = np.concatenate([up[1:], row[:1]])  # above and to the right; the last pixel's is the row's own first
        for start in range(0, width, 1 << block):
            at, end, mode = max(1, start), min(width, start + (1 << block)), modes[y >> block][start >> block]
            mode = 0 if mode > 13 else mode
            if mode == 1:
                row[at - 1 : end] = np.add.accumulate(row[at - 1 : end], axis=0, dtype=np.uint8)
            elif mode in _FROM_ABOVE:
                row[at:end] += np.asarray(_FROM_ABOVE[mode](up[at:end], up[at - 1 : end - 1], right[at:end]), np.uint8)
            else:
                own, above, beside = row[at - 1 : end].tolist(), up[at - 1 : end].tolist(), right[at:end].tolist()
                for i in range(1, len(own)):
                    p = _predicted(mode, own[i - 1], above[i], above[i - 1], beside[i - 1])
                    own[i] = [(a + b) & 255 for a, b in zip(own[i], p, strict=True)]
                row[at:end] = own[1:]
    return ch.view("<u4").reshape(height, width)


def _undo_cross_colour(x: np.ndarray, blocks: np.ndarray, block: int) -> np.ndarray:
    height, width = x.shape
    ch = _channels(x).copy()
    t = _channels(np.repeat(np.repeat(blocks, 1 << block, axis=0)[:height], 1 << block, axis=1)[:, :width]).view(np.int8).astype(np.int32)
    move = lambda by, c: (by * c.view(np.int8).astype(np.int32)) >> 5
    green = np.ascontiguousarray(ch[..., 1])
    red = (ch[..., 2].astype(np.int32) + move(t[..., 0], green)).astype(np.uint8)
    ch[..., 0] = (ch[..., 0].astype(np.int32) + move(t[..., 1], green) + move(t[..., 2], red)).astype(np.uint8)
    ch[..., 2] = red
    return ch.view("<u4").reshape(height, width)


def _undo_palette(x: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    height = x.shape[0]
    size = len(colours)
    bits = 1 if size <= 2 else 2 if size <= 4 else 4 if size <= 16 else 8
    index = (x >> np.uint32(8)) & np.uint32(255)
    each = 8 // bits
    index = ((index[..., None] >> (np.arange(each, dtype=np.uint32) * np.uint32(bits))) & np.uint32((1 << bits) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[:size] = np.add.accumulate(_channels(colours), axis=0, dtype=np.uint8).view("<u4").reshape(-1)
    return full[index]


def read_webp(data: bytes) -> tuple[np.ndarray, dict[bytes, bytes]]:
    """(height, width, 4) RGBA samples of a lossless WebP file, and its other chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    parts, at = {}, 12
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > len(data):
            raise ValueError("the file ends early")
        parts[data[at : at + 4]] = data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    bits = Bits(parts.pop(b"VP8L"))
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    return _channels(read_stream(bits, width, height))[..., [2, 1, 0, 3]], parts


def read_stream(bits: Bits, width: int, height: int) -> np.ndarray:
    """(height, width) 32-bit pixels of a lossless stream after its header: transforms, then the coded image."""
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = 2 + bits.read(3)
            across, down = (coded + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            blocks = _entropy_coded(bits, across, down, False).reshape(down, across)
            undo.append((kind, blocks, block))
        elif kind == 2:
            undo.append((2, None, 0))
        else:
            size = bits.read(8) + 1
            undo.append((3, _entropy_coded(bits, size, 1, False), coded))
            coded = -(-coded * (1 if size <= 2 else 2 if size <= 4 else 4 if size <= 16 else 8) // 8)
    x = _entropy_coded(bits, coded, height, True).reshape(height, coded)
    for kind, table, arg in reversed(undo):
        if kind == 0:
            x = _undo_predictor(x, table, arg)
        elif kind == 1:
            x = _undo_cross_colour(x, table, arg)
        elif kind == 2:
            green = (x >> np.uint32(8)) & np.uint32(255)
            x = (x & np.uint32(0xFF00FF00)) | (((x & np.uint32(0x00FF00FF)) + (green << np.uint32(16)) + green) & np.uint32(0x00FF00FF))
        else:
            x = _undo_palette(x, table, arg)
    return x


def huffman_lengths(weights: list[float], most: int = MOST_BITS) -> np.ndarray:
    """Lengths of a complete prefix code; weights are flattened until no code is longer than ``most``."""
    w = list(weights)
    while True:
        heap = [(x, i, (i,)) for i, x in enumerate(w) if x > 0]
        heapq.heapify(heap)
        lengths, k = np.zeros(len(w), np.uint8), len(w)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                lengths[i] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if lengths.max() <= most:
            return lengths
        w = [x + max(w) / 4096 if x > 0 else 0 for x in w]


class BitWriter:
    """Joins (value, bits) into little-endian bytes, many at a time."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, size: int) -> None:
        self.many(np.array([value], np.uint64), np.array([size], np.int64))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values.astype(np.uint64, copy=False))
        self.sizes.append(sizes.astype(np.int64, copy=False))

    def bytes(self) -> bytes:
        v, n = np.concatenate(self.values), np.concatenate(self.sizes)
        v, n = v[n > 0], n[n > 0]
        ends = np.cumsum(n)
        at = ends - n
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(v << shift, first)
        over = (at & 63) + n > 64
        out[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: int(ends[-1] + 7) >> 3]


def _put_code(w: BitWriter, lengths: np.ndarray) -> None:
    """A normal prefix code, each length written by a flat four-bit or longer length code."""
    kinds = np.unique(lengths)
    of = huffman_lengths(np.bincount(lengths, minlength=19).astype(float).tolist(), 7)
    of[kinds[0]] = of[kinds[0]] or 1  # the only length there is takes no bits below
    codes = _codes(of)
    w.put(0, 1)
    w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(int(of[k]), 3)
    w.put(0, 1)
    if len(kinds) > 1:
        w.many(codes[lengths], of[lengths])


@lru_cache(maxsize=1)
def _text_codes() -> tuple:
    """The encoder's fixed code and the bits that describe it.

    Weights by rule: letters and space fall off by a constant factor in order of use, then come sentence marks, capitals,
    other printable bytes and those of longer UTF-8 characters; all else, and back-references, little.
    """
    weights = [0.02] * 256
    for i in range(33, 127):
        weights[i] = 2.5 if 65 <= i <= 90 else 1.5
    for i in range(128, 192):
        weights[i] = 1.0
    for i, c in enumerate(b" enthaiorsdulcgbfwymzqvpxkj"):
        weights[c] = 154 * 0.87**i
    for c, x in zip(b".,!\n\xc3", (13.0, 10.0, 10.0, 3.0, 26.0), strict=True):
        weights[c] = x
    literal = huffman_lengths(weights)
    green = huffman_lengths(weights + [0.1] * 24)
    head = BitWriter()
    head.put(0, 1)  # no transform
    head.put(0, 1)  # no colour cache
    head.put(0, 1)  # one code group
    _put_code(head, green)
    _put_code(head, literal)
    _put_code(head, literal)
    head.put(1, 1)  # alpha: the one symbol 255
    head.put(0, 1)
    head.put(1, 1)
    head.put(255, 8)
    head.put(1, 1)  # distance: the one symbol 1, which is the pixel to the left
    head.put(0, 1)
    head.put(0, 1)
    head.put(1, 1)
    lead = (np.concatenate(head.values), np.concatenate(head.sizes))
    wide = lambda x: x.astype(np.int64)
    return lead, _codes(green).astype(np.uint64), wide(green), _codes(literal).astype(np.uint64), wide(literal)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their value for a length."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, high - 1, v & ((1 << (high - 1)) - 1)


def write_webp(rgb: np.ndarray, extra: dict[bytes, bytes] | None = None) -> bytes:
    """A lossless WebP file of (height, width, 3) samples."""
    height, width = rgb.shape[:2]
    if max(height, width) > SIDE:
        raise ValueError("the image is too large")
    lead, green_code, green_size, code, size = _text_codes()
    px = np.ascontiguousarray(rgb, np.uint8).reshape(-1, 3)
    w = BitWriter()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 36)
    w.put(0, 4)  # no alpha, version 0
    w.many(*lead)
    same = (px[1:] == px[:-1]).all(axis=1)
    turns = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    runs = [(a + 1, b - a) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if b - a >= 8]
    values = np.stack([green_code[px[:, 1]], code[px[:, 0]], code[px[:, 2]]], axis=1)
    sizes = np.stack([green_size[px[:, 1]], size[px[:, 0]], size[px[:, 2]]], axis=1)
    at = 0
    for start, n in [*runs, (len(px), 0)]:
        if start > at:
            w.many(values[at:start].ravel(), sizes[at:start].ravel())
        at = start + n
        while n:
            k = min(n, 4096)
            symbol, bits, rest = _prefix(k)
            w.put(int(green_code[256 + symbol]), int(green_size[256 + symbol]))
            if bits:
                w.put(rest, bits)
            n -= k
    stream = w.bytes()
    body = b"WEBP"
    for name, data in ((b"VP8L", stream), *(extra or {}).items()):
        body += name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes([PAD]) * ((-len(data)) % BLOCK if data else BLOCK)


def to_image(payload: bytes) -> bytes:
    """A payload as a WebP file; its length stands in a chunk of its own if the last row isn't full."""
    width = ROW
    while -(-len(payload) // (3 * width)) > SIDE:
        width *= 2
    height = -(-len(payload) // (3 * width))
    full = payload + bytes([PAD]) * (3 * width * height - len(payload))
    return write_webp(np.frombuffer(full, np.uint8).reshape(height, width, 3), {b"SIZE": struct.pack("<Q", len(payload))} if len(full) > len(payload) else None)


def from_image(data: bytes) -> tuple[np.ndarray, bytes]:
    """RGB samples and payload of a stored file."""
    x, more = read_webp(data)
    rgb = np.ascontiguousarray(x[..., :3])
    raw = rgb.tobytes()
    return rgb, raw[: struct.unpack("<Q", more[b"SIZE"])[0]] if b"SIZE" in more else raw


def features(rgb: np.ndarray) -> str:
    """Size, mean and deviation of each channel, and the entropy of all samples."""
    p = np.bincount(rgb.ravel(), minlength=256) / rgb.size
    mean = rgb.reshape(-1, 3).mean(axis=0)
    dev = np.sqrt(np.maximum(0, (rgb.reshape(-1, 3).astype(np.float32) ** 2).mean(axis=0, dtype=np.float64) - mean**2))
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{v:.4f}" for v in [*mean, *dev, entropy])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [(n, to_image(p)) for n, p in map(payload_of, b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "media"])


_DECODED = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, width int, height int, pixels array<int>"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files = b.column(2).to_pylist()
        rows, images = [], []
        for data in files:
            x, more = read_webp(data)
            height, width = x.shape[:2]
            size = struct.unpack("<Q", more[b"SIZE"])[0] if b"SIZE" in more else 3 * width * height
            rows.append((len(data), hashlib.sha256(data).hexdigest(), size, width, height))
            images.append(np.ascontiguousarray(x[..., [2, 1, 0, 3]]).view("<i4").ravel())
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        ends = np.cumsum([0, *map(len, images)]).astype(np.int32)
        pixels = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(images) if images else np.empty(0, np.int32), pa.int32()))
        names = [x.split()[0] for x in _DECODED.split(", ")]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pixels], names=names)


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        values, ends = b.column(7).values.to_numpy(), b.column(7).offsets.to_numpy()
        for size, i, j in zip(b.column(4).to_pylist(), ends, ends[1:], strict=False):
            rgb = np.ascontiguousarray(values[i:j].view(np.uint8).reshape(-1, 4)[:, 2::-1])
            payload = rgb.tobytes()[:size]
            rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), rgb))
        shapes = zip(b.column(6).to_pylist(), b.column(5).to_pylist(), strict=True)
        shas, sums, texts = [r[0] for r in rows], [r[1] for r in rows], [features(r[2].reshape(h, w, 3)) for r, (h, w) in zip(rows, shapes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(4), pa.array(shas, pa.string()), pa.array(sums, pa.int64()), b.column(2), b.column(3), pa.array(texts, pa.string())],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's bytes as a lossless WebP file."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with its pixels in place of the file: width, height and ``pixels``, one integer of
    alpha, red, green, blue for each pixel, row by row; ``payload_bytes`` is the length of what the file stores."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, _DECODED)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, from their decoded pixel arrays."""
    return decode(media).mapInArrow(_look, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the media column to files, reads it back and computes its features."""
    return media_features(Settled(media_column(docs, id_col, text_col), codec="uncompressed").df)
