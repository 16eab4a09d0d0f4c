"""4. Media columns: lossless WebP, decoded in step for all images of a batch."""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorespark.llm import kernels as K
from lorespark.llm.frames import texts

WIDTH = 192
ROWS = 32
MAX_BITS = 11
SLICE = 4 << 20

# Fixed values of the format: order in which code-length code lengths are stored, and
# the (x, y) steps of the 120 short distance codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2),
    (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2),
    (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6),
    (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

_STEPS = np.array(DISTANCES, np.int64)
_reversed: dict[int, np.ndarray] = {}


def _reversal(bits: int) -> np.ndarray:
    if bits not in _reversed:
        r = np.zeros(1, np.int64)
        for k in range(bits):
            r = np.concatenate([r, r | 1 << (bits - 1 - k)])
        _reversed[bits] = r
    return _reversed[bits]


def prefix_table(lengths: np.ndarray) -> np.ndarray:
    """Lookup by the next bits of the stream: symbol << 4 | length. A lone symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.array([used[0] << 4], np.uint32)
    if len(used) == 0:
        raise ValueError("a prefix code without symbols")
    size = lengths[used]
    order = np.lexsort((used, size))
    used, size = used[order], size[order]
    bits = int(size[-1])
    table = np.repeat(used << 4 | size, 1 << (bits - size)).astype(np.uint32)
    if len(table) != 1 << bits:
        raise ValueError("an incomplete prefix code")
    return table[_reversal(bits)]


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte:byte + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > len(self.data) * 8 + 64:
            raise ValueError("the stream ends too early")
        return value

    def symbol(self, table: np.ndarray) -> int:
        byte = self.at >> 3
        entry = int(table[(int.from_bytes(self.data[byte:byte + 8], "little") >> (self.at & 7)) & (len(table) - 1)])
        self.at += entry & 15
        return entry >> 4


def read_prefix_code(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return prefix_table(lengths)
    own = np.zeros(19, np.int64)
    for k in CODE_LENGTH_ORDER[:4 + bits.read(4)]:
        own[k] = bits.read(3)
    table = prefix_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before, mask, entries, data, bit = 0, 8, len(table) - 1, table.tolist(), bits.data, bits.at
    window = have = 0
    sizes = [0] * (alphabet + 138)
    while at < alphabet and left:
        left -= 1
        if have < 14:  # a code of 7 bits and as many more
            if bit > len(data) * 8 + 64:
                raise ValueError("the stream ends too early")
            window, have = int.from_bytes(data[bit >> 3:(bit >> 3) + 8], "little") >> (bit & 7), 64 - (bit & 7)
        entry = entries[window & mask]
        s, n = entry >> 4, entry & 15
        more = 0 if s < 16 else (2, 3, 7)[s - 16]
        extra = window >> n & ((1 << more) - 1)
        window >>= n + more
        have -= n + more
        bit += n + more
        if s < 16:
            sizes[at] = s
            before = s or before
            at += 1
        elif s == 16:
            sizes[at:at + 3 + extra] = [before] * (3 + extra)
            at += 3 + extra
        else:
            at += (3 if s == 17 else 11) + extra
    bits.at = bit
    lengths[:] = sizes[:alphabet]
    if at > alphabet:
        raise ValueError("code lengths beyond the alphabet")
    return prefix_table(lengths)


class Image:
    """What the header of one entropy-coded image says; decoded pixels come into ``out`` (ARGB)."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.data, self.width, self.height = bits.data, width, height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("a colour cache of more than 11 bits")
        self.meta, self.meta_bits, groups = None, 0, 1
        if main and bits.read(1):
            self.meta_bits = bits.read(3) + 2
            step = 1 << self.meta_bits
            meta = decode_image(bits, -(-width // step), -(-height // step))
            self.meta = (meta >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
            groups = int(self.meta.max()) + 1
        cache = 1 << self.cache_bits if self.cache_bits else 0
        self.groups = [[read_prefix_code(bits, n) for n in (256 + 24 + cache, 256, 256, 256, 40)] for _ in range(groups)]
        self.start = self.end = bits.at
        self.out = np.zeros(0, np.uint32)

    @property
    def green_only(self) -> bool:
        """Only green varies, by one code and without a cache."""
        return not self.cache_bits and self.meta is None and all(len(t) == 1 for t in self.groups[0][1:4])

    @property
    def plain(self) -> bool:
        """Only green varies, and all of it is literal."""
        return self.green_only and int(self.groups[0][0].max()) >> 4 < 256 and len(self.groups[0][0]) <= 1 << 11


def decode_image(bits: Bits, width: int, height: int) -> np.ndarray:
    """One image of the stream that ``bits`` stands in (sub-images have no meta codes)."""
    image = Image(bits, width, height, False)
    in_step([image])
    bits.at = image.end
    return image.out.reshape(height, width)


def in_step(images: list[Image]) -> None:
    """Decodes the pixels of all images together: one numpy operation moves every image on by a symbol."""
    plain = [i for i in images if i.plain]
    copied = [i for i in images if i.green_only and not i.plain]
    rest = [i for i in images if not i.green_only]
    if plain:
        _plain_in_step(sorted(plain, key=lambda i: -i.width * i.height))
    if copied:
        _copied_in_step(copied)
    if rest:
        _general_in_step(rest)


def _stream(images: list[Image]) -> tuple[np.ndarray, np.ndarray]:
    """At each 32-bit word of all streams, the next 64 bits; and each image's bit position."""
    parts, at, where = [], 0, []
    for i in images:
        skip = i.start >> 5 << 2
        part = i.data[skip:]
        part += b"\0" * (8 + -len(part) % 4)
        where.append(at * 8 + i.start - skip * 8)
        parts.append(part)
        at += len(part)
    words = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
    words[:-1] |= words[1:] << np.uint64(32)
    return words, np.array(where, np.int64)


def _plain_in_step(images: list[Image]) -> None:
    words, at = _stream(images)
    begin = at.copy()
    sizes = np.array([i.width * i.height for i in images], np.int64)
    tables = [i.groups[0][0] for i in images]
    offset = np.cumsum([0] + [len(t) for t in tables])[:-1]
    mask = np.array([len(t) - 1 for t in tables], np.uint64)
    flat = np.concatenate(tables)
    symbol, length = (flat >> 4).astype(np.uint8), (flat & 15).astype(np.uint8)
    base = np.cumsum(sizes) - sizes
    green = np.zeros(int(sizes.sum()), np.uint8)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # images with more than t pixels
    window = words[:0]
    for t in range(int(sizes[0])):
        n = active[t]
        if t % 3 == 0:  # 33 bits hold three codes of 11
            shift = (at[:n] & 31).astype(np.uint64)
            window = words[at[:n] >> 5] >> shift
        else:
            window = window[:n]
        k = offset[:n] + (window & mask[:n]).astype(np.int64)
        used = length[k]
        window = window >> used
        at[:n] += used
        green[base[:n] + t] = symbol[k]
    for i, b, n, start, end in zip(images, base, sizes, begin, at, strict=True):
        i.out = green[b:b + n].astype(np.uint32) << np.uint32(8) | _constant(i)
        i.end = i.start + int(end - start)


def _constant(image: Image) -> np.uint32:
    """Red, blue and alpha of an image of which only green varies."""
    return np.uint32(sum((int(image.groups[0][c][0]) >> 4) << s for c, s in ((1, 16), (2, 0), (3, 24))))


def _copied_in_step(images: list[Image]) -> None:
    """Literals and back-references of green; what is copied is looked up at the end, for all pixels together."""
    words, start = _stream(images)
    sizes = np.array([i.width * i.height for i in images], np.int64)
    base = np.cumsum(sizes) - sizes
    tables = [i.groups[0][c] for i in images for c in (0, 4)]
    place = np.cumsum([0] + [len(t) for t in tables])[:-1].reshape(-1, 2)
    masks = np.array([len(t) - 1 for t in tables], np.uint64).reshape(-1, 2)
    flat = np.concatenate([*tables, np.zeros(1, np.uint32)])
    is_green = np.append(np.repeat(np.arange(len(tables)) % 2 == 0, [len(t) for t in tables]), True)
    symbol, coded = (flat >> 4).astype(np.int64), flat & 15
    # Of each entry: the number that its prefix begins, the mask of its extra bits, and the bits of code and extra bits.
    prefix = np.where(is_green, np.maximum(symbol - 256, 0), symbol)
    n_more = np.where((prefix < 4) | (is_green & (symbol < 256)), 0, np.maximum(prefix - 2, 0) >> 1)
    number = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << n_more) + 1
    more, taken, coded = ((1 << n_more) - 1).astype(np.uint64), n_more + coded, coded.astype(np.uint64)
    copy, value = is_green & (symbol >= 256), symbol.astype(np.uint8)
    spare, never, idle = int(sizes.max()) + 1, 1 << 62, 0
    green = np.zeros(int(sizes.sum()) + spare, np.uint8)
    done_at = start.copy()
    lane, at, pos, end = np.arange(len(images)), start.copy(), base.copy(), base + sizes
    offset, mask, offset_back, mask_back = place[:, 0].copy(), masks[:, 0].copy(), place[:, 1], masks[:, 1]
    copies: list[tuple[np.ndarray, ...]] = []
    while len(lane):
        if int(at.max()) >> 5 >= len(words):
            raise ValueError("the stream ends too early")
        bits = words[at >> 5] >> (at & 31).astype(np.uint64)
        entry = offset + (bits & mask).astype(np.int64)
        at += taken[entry]
        green[pos] = value[entry]
        k = np.flatnonzero(copy[entry])
        if len(k):
            e, own = entry[k], at[k]
            length = number[e] + ((bits[k] >> coded[e]) & more[e]).astype(np.int64)
            bits = words[np.minimum(own >> 5, len(words) - 1)] >> (own & 31).astype(np.uint64)
            e = offset_back[k] + (bits & mask_back[k]).astype(np.int64)
            at[k] = own + taken[e]
            length = np.minimum(length, end[k] - pos[k])
            copies.append((lane[k], pos[k], length, number[e] + ((bits >> coded[e]) & more[e]).astype(np.int64)))
            pos[k] += length - 1
        pos += 1
        over = np.flatnonzero(pos >= end)
        if len(over):  # these stand idle, on the last entry and behind the pixels, until a few are taken out together
            done_at[lane[over]] = at[over]
            at[over], pos[over], end[over], offset[over], mask[over] = 0, len(green) - spare, never, len(symbol) - 1, 0
            idle += len(over)
            if idle * 16 > len(lane):
                left = end < never
                lane, at, pos, end, offset, mask, offset_back, mask_back = (x[left] for x in (lane, at, pos, end, offset, mask, offset_back, mask_back))
                idle = 0
    if copies:
        lane, first, length, code = (np.concatenate(c) for c in zip(*copies, strict=True))
        step = _STEPS[np.minimum(code, 120) - 1]
        width = np.array([i.width for i in images], np.int64)[lane]
        back = np.where(code > 120, code - 120, np.maximum(step[:, 0] + step[:, 1] * width, 1))
        if (back > first - base[lane]).any():
            raise ValueError("a back-reference before the first pixel")
        to = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        source = np.arange(len(green))
        source[to] = to - np.repeat(back, length)
        while True:  # a copy of a copy is that of its source: each turn doubles the way
            further = source[source[to]]
            if (further == source[to]).all():
                break
            source[to] = further
        green[to] = green[source[to]]
    for i, b, n, begin, stop in zip(images, base, sizes, start, done_at, strict=True):
        i.out = green[b:b + n].astype(np.uint32) << np.uint32(8) | _constant(i)
        i.end = i.start + int(stop - begin)


def _general_in_step(images: list[Image]) -> None:
    """Literals, back-references and colour cache, with several code groups."""
    words, at = _stream(images)
    begin = at.copy()
    n = len(images)
    sizes = np.array([i.width * i.height for i in images], np.int64)
    base = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    width = np.array([i.width for i in images], np.int64)
    tables = [t for i in images for g in i.groups for t in g]
    offset = np.cumsum([0] + [len(t) for t in tables])[:-1].reshape(-1, 5)
    mask = np.array([len(t) - 1 for t in tables], np.int64).reshape(-1, 5)
    flat = np.concatenate(tables)
    first_group = np.cumsum([0] + [len(i.groups) for i in images])[:-1]
    metas = [np.zeros(1, np.int64) if i.meta is None else i.meta.ravel() for i in images]
    meta_at = np.cumsum([0] + [len(m) for m in metas])[:-1]
    meta = np.concatenate(metas)
    meta_bits = np.array([i.meta_bits if i.meta is not None else 30 for i in images], np.int64)
    meta_width = np.array([1 if i.meta is None else i.meta.shape[1] for i in images], np.int64)
    cache_bits = np.array([i.cache_bits for i in images], np.int64)
    cache_at = np.cumsum([0] + [1 << i.cache_bits for i in images])[:-1]
    cache = np.zeros(int(cache_at[-1]) + (1 << images[-1].cache_bits), np.uint32)
    pos = np.zeros(n, np.int64)
    limit = int(sum(len(i.data) for i in images)) * 8 + 64 * n + 64

    def bits(lane: np.ndarray, count: np.ndarray) -> np.ndarray:
        value = (words[at[lane] >> 5] >> (at[lane] & 31).astype(np.uint64)) & ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1))
        at[lane] += count
        return value.astype(np.int64)

    def symbol(lane: np.ndarray, group: np.ndarray, code: int) -> np.ndarray:
        value = (words[at[lane] >> 5] >> (at[lane] & 31).astype(np.uint64)).astype(np.int64)
        entry = flat[offset[group, code] + (value & mask[group, code])].astype(np.int64)
        at[lane] += entry & 15
        return entry >> 4

    def number(lane: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        extra = np.maximum(prefix - 2, 0) >> 1
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + bits(lane, np.where(prefix < 4, 0, extra)) + 1)

    def remember(lane: np.ndarray, argb: np.ndarray) -> None:
        has = cache_bits[lane] > 0
        if has.any():
            lane, argb = lane[has], argb[has]
            key = (argb.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> (32 - cache_bits[lane]).astype(np.uint64)
            cache[cache_at[lane] + key.astype(np.int64)] = argb

    lanes = np.flatnonzero(sizes > 0)
    while len(lanes):
        if int(at.max()) > limit:
            raise ValueError("the stream ends too early")
        p = pos[lanes]
        y, x = p // width[lanes], p % width[lanes]
        block = (y >> meta_bits[lanes]) * meta_width[lanes] + (x >> meta_bits[lanes])
        group = first_group[lanes] + meta[meta_at[lanes] + block]
        green = symbol(lanes, group, 0)
        k = np.flatnonzero(green < 256)
        if len(k):
            lane, g = lanes[k], group[k]
            red, blue, alpha = (symbol(lane, g, c) for c in (1, 2, 3))
            argb = (alpha << 24 | red << 16 | green[k] << 8 | blue).astype(np.uint32)
            out[base[lane] + pos[lane]] = argb
            remember(lane, argb)
            pos[lane] += 1
        k = np.flatnonzero(green >= 280)
        if len(k):
            lane = lanes[k]
            argb = cache[cache_at[lane] + green[k] - 280]
            out[base[lane] + pos[lane]] = argb
            remember(lane, argb)
            pos[lane] += 1
        k = np.flatnonzero((green >= 256) & (green < 280))
        if len(k):
            lane, g = lanes[k], group[k]
            length = number(lane, green[k] - 256)
            code = number(lane, symbol(lane, g, 4))
            step = _STEPS[np.minimum(code, 120) - 1]
            distance = np.where(code > 120, code - 120, np.maximum(step[:, 0] + step[:, 1] * width[lane], 1))
            for q, size, back in zip(lane.tolist(), length.tolist(), distance.tolist(), strict=True):
                to, size = int(base[q] + pos[q]), min(size, int(sizes[q] - pos[q]))
                if back > pos[q]:
                    raise ValueError("a back-reference before the first pixel")
                out[to:to + size] = np.resize(out[to - back:to - back + min(back, size)], size)
                if cache_bits[q]:
                    remember(np.full(size, q), out[to:to + size])  # of one key the last stays
                pos[q] += size
        lanes = lanes[pos[lanes] < sizes[lanes]]
    for i, b, size, start, end in zip(images, base, sizes, begin, at, strict=True):
        i.out, i.end = out[b:b + size], i.start + int(end - start)


def _channels(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers to a last axis of alpha, red, green, blue."""
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view(">u4")[..., 0].astype(np.uint32)


ROW_MODES = (2, 3, 4, 8, 9)  # predictions from the row above alone


def _of_row(mode: int, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    if mode < 5:
        return (top, right, corner)[mode - 2]
    return ((corner, right)[mode - 8] + top) >> 1


def _invert_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds the prediction of each pixel, row by row: modes of a left neighbour need the row in order."""
    d = _channels(argb).astype(np.int32)
    out = np.zeros_like(d)
    height, width = argb.shape
    half = lambda a, b: (a + b) >> 1

    def predict(mode: int, y: int, x: int) -> np.ndarray:
        left, top, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
        right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
        if mode == 1:
            return left
        if mode in (2, 3, 4):
            return (top, right, corner)[mode - 2]
        if mode == 5:
            return half(half(left, right), top)
        if mode in (6, 7):
            return half(left, (corner, top)[mode - 6])
        if mode in (8, 9):
            return half((corner, right)[mode - 8], top)
        if mode == 10:
            return half(half(left, corner), half(top, right))
        if mode == 11:
            guess = left + top - corner
            return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
        if mode == 12:
            return np.clip(left + top - corner, 0, 255)
        if mode == 13:
            mean = half(left, top)
            return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)
        return np.array([255, 0, 0, 0], np.int32)

    out[0, 0] = (d[0, 0] + np.array([255, 0, 0, 0])) & 255
    if width > 1:
        out[0, 1:] = (np.cumsum(d[0, 1:], axis=0) + out[0, 0]) & 255
    for y in range(1, height):
        out[y, 0] = (d[y, 0] + out[y - 1, 0]) & 255
        row = np.unique(modes[y >> bits])
        if len(row) == 1 and row[0] in (1, *ROW_MODES):
            above = out[y - 1]
            right = np.concatenate([above[2:], out[y, :1]])
            if row[0] == 1:
                out[y] = np.cumsum(np.concatenate([out[y, :1], d[y, 1:]]), axis=0) & 255
            elif width > 1:
                out[y, 1:] = (d[y, 1:] + _of_row(int(row[0]), above[1:], above[:-1], right)) & 255
            continue
        for x in range(1, width):
            out[y, x] = (d[y, x] + predict(int(modes[y >> bits, x >> bits]), y, x)) & 255
    return _packed(out.astype(np.uint8))


def _invert_cross_colour(argb: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    c = _channels(argb).astype(np.int32)
    y, x = np.indices(argb.shape)
    f = _channels(factors)[y >> bits, x >> bits].view(np.int8).astype(np.int32)
    signed_ = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green_to_red, green_to_blue, red_to_blue = f[..., 3], f[..., 2], f[..., 1]
    green = signed_(c[..., 2])
    red = (c[..., 1] + (green_to_red * green >> 5)) & 255
    c[..., 3] = (c[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * signed_(red) >> 5)) & 255
    c[..., 1] = red
    return _packed(c.astype(np.uint8))


def _invert_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb).copy()
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _packed(c)


def _invert_palette(argb: np.ndarray, palette: np.ndarray, width: int, packing: int) -> np.ndarray:
    index = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if packing:
        size = 8 >> packing
        x = np.arange(width)
        index = index[:, x >> packing] >> (x % (1 << packing) * size) & ((1 << size) - 1)
    return np.where(index < len(palette), palette[np.minimum(index, len(palette) - 1)], 0).astype(np.uint32)


class File:
    """One RIFF container with a lossless chunk: its transforms and main image."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size = struct.unpack("<I", data[16:20])[0]
        bits = Bits(data[20:20 + size])
        if bits.read(8) != 0x2F:
            raise ValueError("a wrong signature")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("an unknown version")
        width, self.transforms = self.width, []
        while bits.read(1):
            kind = bits.read(2)
            if kind in {t[0] for t in self.transforms}:
                raise ValueError("a transform stands twice")
            if kind < 2:
                block = bits.read(3) + 2
                rows, cols = -(-self.height // (1 << block)), -(-width // (1 << block))
                self.transforms.append((kind, block, decode_image(bits, cols, rows)))
            elif kind == 2:
                self.transforms.append((2, 0, None))
            else:
                count = bits.read(8) + 1
                palette = _packed(np.cumsum(_channels(decode_image(bits, count, 1)[0]), axis=0, dtype=np.uint8))
                packing = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
                self.transforms.append((3, packing, (palette, width)))
                width = -(-width // (1 << packing))
        self.image = Image(bits, width, self.height, True)

    def pixels(self) -> np.ndarray:
        """ARGB, after the main image was decoded: the transforms are inverted, the last first."""
        argb = self.image.out.reshape(self.height, self.image.width)
        for kind, setting, data in reversed(self.transforms):
            if kind == 0:
                argb = _invert_predictor(argb, (data >> np.uint32(8) & np.uint32(15)), setting)
            elif kind == 1:
                argb = _invert_cross_colour(argb, data, setting)
            elif kind == 2:
                argb = _invert_green(argb)
            else:
                argb = _invert_palette(argb, data[0], data[1], setting)
        return argb


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels of each file (height x width)."""
    parsed = [File(f) for f in files]
    in_step([f.image for f in parsed])
    return [f.pixels() for f in parsed]


def split_files(stored: bytes) -> list[bytes]:
    """The containers that stand one after another in a stored value."""
    out, at = [], 0
    while at < len(stored):
        size = 8 + struct.unpack("<I", stored[at + 4:at + 8])[0]
        out.append(stored[at:at + size + (size & 1)])
        at += size + (size & 1)
    return out


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; counts are flattened until they fit."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        tick = len(used)
        while len(heap) > 1:
            wa, a = heapq.heappop(heap)
            wb, b = heap[0]
            above[a] = above[b] = tick
            heapq.heapreplace(heap, (wa + wb, tick))
            tick += 1
        depth = [0] * tick
        for i in range(tick - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[:len(used)]) <= most:
            lengths[used] = depth[:len(used)]
            return lengths
        weights = [(w >> 1) + 1 for w in weights]


# The code of the code lengths that the encoder writes: lengths 0 to 11 and the two runs of zeros.
_META_LENGTHS = np.array([3, *[4] * 11, 0, 0, 0, 0, 0, 4, 3], np.int64)


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as they are written, first bit lowest."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    most = int(lengths.max())
    span = 1 << (most - lengths[order])
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = _reversal(most)[(np.cumsum(span) - span) & ((1 << most) - 1)]
    return codes


_META_CODES = list(zip(_canonical(_META_LENGTHS).tolist(), _META_LENGTHS.tolist(), strict=True))


class Writer:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def simple(self, symbol: int) -> None:
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)

    def code(self, lengths: np.ndarray) -> None:
        """A normal prefix code."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) == 1 and used[0] < 256:
            self.simple(used[0])
            return
        self.put(0, 1)
        last = max(i for i, k in enumerate(CODE_LENGTH_ORDER) if _META_LENGTHS[k]) + 1
        self.put(last - 4, 4)
        for k in CODE_LENGTH_ORDER[:last]:
            self.put(int(_META_LENGTHS[k]), 3)
        self.put(0, 1)
        at, sizes = 0, lengths.tolist()
        for s in [*used, len(lengths)]:
            gap = s - at
            while gap >= 11:
                n = min(gap, 138)
                self._meta(18)
                self.put(n - 11, 7)
                gap -= n
            while gap >= 3:
                n = min(gap, 10)
                self._meta(17)
                self.put(n - 3, 3)
                gap -= n
            for _ in range(gap):
                self._meta(0)
            if s < len(lengths):
                self._meta(sizes[s])
            at = s + 1

    def _meta(self, symbol: int) -> None:
        self.put(*_META_CODES[symbol])


def container(chunk: bytes) -> bytes:
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded


TILES = 1024  # encoded together
MATCH = 6  # bytes that a back-reference copies at least
MOST_COPIED = 4096
CACHE_BITS = 4
GREENS = 280 + (1 << CACHE_BITS)


_LOG2 = np.log2(np.maximum(np.arange(WIDTH * ROWS + 1), 1))


def _bits(counts: np.ndarray) -> np.ndarray:
    """Bits that the symbols of each row of counts take about, one at least if there are two, and some five for each symbol's code length."""
    c = counts.astype(np.int64)
    n, used = c.sum(axis=1), np.count_nonzero(c, axis=1)
    each = np.maximum(_LOG2[n][:, None] - _LOG2[c], used[:, None] > 1)
    return np.einsum("ij,ij->i", c, each) + 5 * used


def _histograms(owner: np.ndarray, symbols: np.ndarray, n: int, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner * size + symbols, weights, n * size).reshape(n, size)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths and distance codes (from 1)."""
    v = value - 1
    k = np.maximum(np.frexp(v.astype(np.float64))[1] - 1, 1)
    half = (v >> (k - 1)) & 1
    small = value <= 4
    return np.where(small, v, 2 * k + half), np.where(small, 0, v - ((2 + half) << (k - 1))), np.where(small, 0, k - 1)


def _distance_codes(distance: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The short code where a distance has one in images of its width, else the distance and 120."""
    code = distance + 120
    for w in np.unique(width).tolist():
        steps = np.maximum(_STEPS[:, 0] + _STEPS[:, 1] * w, 1)
        near = np.zeros(int(steps.max()) + 1, np.int64)
        near[steps[::-1]] = np.arange(120, 0, -1)
        own = np.flatnonzero((width == w) & (distance < len(near)))
        code[own] = np.where(near[distance[own]] > 0, near[distance[own]], code[own])
    return code


def _residuals(pixels: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """What each mode of prediction leaves of the pixels; ``at``: a pixel's place in its image. No image reads another's pixels."""
    back = lambda k: np.concatenate([np.zeros(min(k, len(pixels)), np.uint8), pixels[:max(len(pixels) - k, 0)]])
    left, top, corner, right = (back(k) for k in (1, WIDTH, WIDTH + 1, WIDTH - 1))
    row, column, begin = np.flatnonzero(at < WIDTH), np.flatnonzero(at % WIDTH == 0), np.flatnonzero(at == 0)
    for mode in (1, *ROW_MODES):
        guess = left.copy() if mode == 1 else _of_row(mode, *(x.astype(np.uint16) for x in (top, corner, right))).astype(np.uint8)
        guess[column] = top[column]
        guess[row] = left[row]
        guess[begin] = 0
        yield mode, pixels - guess


def _matches(plane: np.ndarray, tile: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the back-references of each image, which do not overlap.

    Every place is held against the last one of its image that begins with the same bytes;
    neighbours of one distance are one reference.
    """
    if len(plane) < MATCH:
        return (np.zeros(0, np.int64),) * 3
    key = np.zeros(len(plane) - MATCH + 1, np.uint64)
    for k in range(MATCH):
        key |= plane[k:len(key) + k].astype(np.uint64) << np.uint64(8 * k)
    place = np.flatnonzero(at[:len(key)] <= size[tile[:len(key)]] - MATCH)
    mixed = (key[place] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    group = np.sort(mixed << np.uint64(23) | (tile[place] << 13 | at[place]).astype(np.uint64))
    begin = np.zeros(len(size), np.int64)
    begin[tile[at == 0]] = np.flatnonzero(at == 0)
    low = (group & np.uint64((1 << 23) - 1)).astype(np.int64)
    where = begin[low >> 13] + (low & 8191)
    same = np.flatnonzero((group[1:] >> np.uint64(13) == group[:-1] >> np.uint64(13)) & (key[where[1:]] == key[where[:-1]]))
    distance = np.zeros(len(plane) + 1, np.int64)
    distance[where[same + 1]] = where[same + 1] - where[same]
    change = np.flatnonzero(np.diff(distance, prepend=0) | (np.append(at, 0) == 0))
    start, stop = change, np.append(change[1:], len(plane))
    start, stop = start[distance[change] > 0], stop[distance[change] > 0] + MATCH - 1
    back = distance[start]
    if len(start):
        start = np.maximum(start, np.append(0, np.maximum.accumulate(stop)[:-1]))
    keep = stop - start >= MATCH
    start, length, back = start[keep], (stop - start)[keep], back[keep]
    parts = -(-length // MOST_COPIED)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start, length, back = np.repeat(start, parts) + nth * MOST_COPIED, np.repeat(length, parts) - nth * MOST_COPIED, np.repeat(back, parts)
    return start, np.minimum(length, MOST_COPIED), back


def _cached(plane: np.ndarray, tile: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in a colour cache, and whether it is there: the last pixel of its image with that place is equal."""
    argb = np.arange(256, dtype=np.uint64) << np.uint64(8) | np.array([[0], [255 << 24]], np.uint64)
    places = ((argb * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.uint8)
    key = places.ravel()[((alpha > 0) * 256)[tile] + plane]
    order = np.argsort(key, kind="stable")
    what = tile[order] * 256 + plane[order]  # two colours of one place differ, as do those of two images
    hit = np.zeros(len(plane), bool)
    hit[order[1:]] = (what[1:] == what[:-1]) & (key[order[1:]] == key[order[:-1]])
    return key, hit


def _palette_image(w: Writer, colours: np.ndarray) -> None:
    """The colour table of greens, as differences."""
    deltas = np.diff(colours, prepend=0) & 255
    counts = np.bincount(deltas, minlength=280)
    lengths = code_lengths(counts)
    w.put(0, 1)
    w.code(lengths if lengths.any() else counts)
    w.simple(0)
    w.simple(0)
    if len(colours) > 1:
        w.code(np.bincount([0, 255], minlength=256))
    else:
        w.simple(255)
    w.simple(0)
    codes = _canonical(lengths)
    for k, d in enumerate(deltas.tolist()):
        w.put(int(codes[d]), int(lengths[d]))
        if len(colours) > 1:
            w.put(int(k == 0), 1)


def _transformed(pixels: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """The bytes that are coded of each image, their number, the images' widths, and each one's transform (predictor mode, palette).

    An image gets the transform by which its symbols take the fewest bits.
    """
    n = len(size)
    tile = np.repeat(np.arange(n), size)
    at = np.arange(len(pixels)) - np.repeat(first, size)
    counts = _histograms(tile, pixels, n, 256)
    best, mode, chosen = _bits(counts), np.zeros(n, np.int64), pixels
    for m, rest in _residuals(pixels, at):
        cost = _bits(_histograms(tile, rest, n, 256)) + 70
        better = cost < best
        best, mode = np.where(better, cost, best), np.where(better, m, mode)
        chosen = np.where(better[tile], rest, chosen) if better.any() else chosen
    planes, transforms, widths = [], [], np.full(n, WIDTH)
    few = np.count_nonzero(counts, axis=1) <= 16
    for t in range(n):
        plane, colours = chosen[first[t]:first[t] + size[t]], np.zeros(0, np.int64)
        if few[t]:
            table = np.flatnonzero(counts[t])
            packing = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1
            bits = 8 >> packing
            index = np.searchsorted(table, pixels[first[t]:first[t] + size[t]]).reshape(-1, 1 << packing)
            packed = (index << np.arange(1 << packing) * bits).sum(axis=1).astype(np.uint8)
            if _bits(np.bincount(packed, minlength=256)[None])[0] + 110 + 10 * len(table) < best[t]:
                plane, colours, mode[t], widths[t] = packed, table, 0, WIDTH >> packing
        planes.append(plane)
        transforms.append((int(mode[t]), colours))
    return np.concatenate(planes), np.array([len(p) for p in planes], np.int64), widths, transforms


def _head(rows: int, mode: int, colours: np.ndarray, cached: bool) -> Writer:
    """A file's header and its transform, up to the main image's codes."""
    w = Writer()
    w.put(0x2F, 8)
    w.put(WIDTH - 1, 14)
    w.put(rows - 1, 14)
    w.put(0, 1 + 3)  # no alpha, version 0
    if mode:
        w.put(1, 1)
        w.put(0, 2)
        w.put(7, 3)  # one block of 512 x 512
        w.put(0, 1)
        for symbol in (mode, 0, 0, 255, 0):
            w.simple(symbol)
    if len(colours):
        w.put(1, 1)
        w.put(3, 2)
        w.put(len(colours) - 1, 8)
        _palette_image(w, colours)
    w.put(0, 1)  # no more transforms
    if cached:
        w.put(1, 1)
        w.put(CACHE_BITS, 4)
    w.put(0, 1 if cached else 2)  # no cache else, no meta codes
    return w


def _encode_tiles(pixels: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A file of each image of ``size`` grey pixels from ``first`` on."""
    n = len(size)
    plane, planned, widths, transforms = _transformed(pixels, first, size)
    tile = np.repeat(np.arange(n), planned)
    at = np.arange(len(plane)) - np.repeat(np.cumsum(planned) - planned, planned)
    start, length, back = _matches(plane, tile, at, planned)
    owner = tile[start]
    of_length, more, n_more = _prefixed(length)
    of_back, far, n_far = _prefixed(_distance_codes(back, widths[owner]))
    literal = np.ones(len(plane), bool)
    literal[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = False
    key, hit = _cached(plane, tile, np.array([0 if mode else 255 for mode, _ in transforms]))
    symbol = np.where(hit, 280 + key.astype(np.int64), plane)
    spelt = _histograms(owner, 256 + of_length, n, GREENS)
    backs = _histograms(owner, of_back, n, 40)
    extra_bits = _bits(backs) + np.bincount(owner, n_more + n_far, n)
    choices = [_histograms(tile, plane, n, GREENS), _histograms(tile[literal], plane[literal], n, GREENS) + spelt]
    costs = [_bits(choices[0]), _bits(choices[1]) + extra_bits]
    often = np.bincount(tile[hit], minlength=n) * 2 > planned
    if often.any():  # a cache that has fewer of the pixels spells them in more ways
        own = np.flatnonzero(often[tile])
        choices.append(_histograms(tile[own], symbol[own], n, GREENS))
        own = own[literal[own]]
        choices.append(_histograms(tile[own], symbol[own], n, GREENS) + spelt)
        # a cache must save a fiftieth
        costs += [np.where(often, _bits(choices[2]) * 1.02, np.inf), np.where(often, (_bits(choices[3]) + extra_bits) * 1.02, np.inf)]
    chosen = np.argmin(costs, axis=0)
    greens = np.choose(chosen[:, None], choices)
    copied, cached = chosen % 2 == 1, chosen > 1
    backs[~copied] = 0
    literal |= ~copied[tile]
    kept = copied[owner]
    lengths, codes = np.zeros((n, GREENS + 40), np.int64), np.zeros((n, GREENS + 40), np.int64)
    heads = []
    for t in range(n):
        w = _head(int(size[t]) // WIDTH, *transforms[t], bool(cached[t]))
        for counts, lo in ((greens[t, :GREENS if cached[t] else 280], 0), (None, 0), (backs[t], GREENS)):
            if counts is None:
                for same in (0, 0, 0 if transforms[t][0] else 255):
                    w.simple(same)
                continue
            if not counts.any():
                w.simple(0)
                continue
            own = code_lengths(counts)
            w.code(own if own.any() else (counts > 0).astype(np.int64))
            lengths[t, lo:lo + len(own)] = own
            codes[t, lo:lo + len(own)] = _canonical(own)
        heads.append(w)
    # Fields: a literal's or a cached colour's code; a copy's length with its extra bits, and its distance with its own.
    symbol = np.where(cached[tile], symbol, plane)
    symbol[start[kept]] = 256 + of_length[kept]
    extra = np.zeros((2, len(plane)), np.int64)
    extra[:, start[kept]] = more[kept], n_more[kept]
    token = literal.copy()
    token[start[kept]] = True
    row = np.flatnonzero(token)
    place = tile[row] * (GREENS + 40) + symbol[row]
    n_code = lengths.ravel()[place]
    field, n_bits = codes.ravel()[place] | extra[0, row] << n_code, n_code + extra[1, row]
    second = np.searchsorted(row, start[kept]) + 1
    place = owner[kept] * (GREENS + 40) + GREENS + of_back[kept]
    n_code = lengths.ravel()[place]
    field, n_bits = np.insert(field, second, codes.ravel()[place] | far[kept] << n_code), np.insert(n_bits, second, n_code + n_far[kept])
    of = np.insert(tile[row], second, owner[kept])
    body = np.bincount(of, n_bits, n).astype(np.int64)
    head = np.array([w.n for w in heads], np.int64)
    words = -(-(head + body) // 32)
    base = np.cumsum(words) - words
    before = np.cumsum(body) - body
    to = np.cumsum(n_bits) - n_bits - before[of] + base[of] * 32 + head[of]
    shifted = field << (to & 31)
    total = int(words.sum()) + 1
    made = np.bincount(to >> 5, weights=(shifted & 0xFFFFFFFF).astype(np.float64), minlength=total)
    made += np.bincount((to >> 5) + 1, weights=(shifted >> 32).astype(np.float64), minlength=total)[:len(made)]
    stream = made.astype(np.uint64).astype("<u4").tobytes()
    files = []
    for t, w in enumerate(heads):
        raw = stream[int(base[t]) * 4:int(base[t] + words[t]) * 4]
        n_head = (w.n + 31) // 32 * 4
        whole = (int.from_bytes(raw[:n_head], "little") | w.value).to_bytes(n_head, "little") + raw[n_head:]
        files.append(container(whole[:-(-int(head[t] + body[t]) // 8)]))
    return files


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each payload (a multiple of 192 bytes) as grey images of 192 x 32 pixels at most, one file after another.

    A sample is a pixel's green. Every image has its own Huffman codes and, where that is
    estimated to take fewer bits, a predictor (one of six modes for all of it) or a palette with
    several pixels a byte, back-references, and a colour cache. Red, blue and alpha take no
    bits, as they are constant, so the transforms between colours have nothing to save.
    """
    tile = WIDTH * ROWS
    n_tiles = -(-np.diff(offsets) // tile)
    owner = np.repeat(np.arange(len(n_tiles)), n_tiles)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n_tiles) - n_tiles, n_tiles)
    start = offsets[owner] + k * tile
    size = np.minimum(tile, offsets[owner + 1] - start)
    files: list[list[bytes]] = [[] for _ in n_tiles]
    for lo in range(0, len(owner), TILES):
        own = slice(lo, lo + TILES)
        made = _encode_tiles(data[start[lo]:start[own][-1] + size[own][-1]], start[own] - start[lo], size[own])
        for t, file in zip(owner[own].tolist(), made, strict=True):
            files[t].append(file)
    return [b"".join(f) for f in files]


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's payload as lossless WebP files.

    The payload is the UTF-8 text (null: empty) and as many blanks as make it a positive
    multiple of 192 bytes. A long text makes several images, one after another.
    Equal texts give equal bytes; rows of any id, null too, are carried.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for lo, hi, d, o in K.slices(data, offsets, SLICE):
                n = np.diff(o)
                padded = np.maximum(-(-n // WIDTH), 1) * WIDTH
                at = np.concatenate([[0], np.cumsum(padded)]).astype(np.int64)
                payload = np.full(int(at[-1]), 32, np.uint8)
                payload[np.arange(len(d)) + np.repeat(at[:-1] - o[:-1], n)] = d
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(encode_payloads(payload, at), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Decodes ``media`` and describes what was read back: the payload's size and digests, the stored form's, and a feature.

    Equal texts give equal values; rows of any id, null too, are carried; an empty table
    gives no rows. Only doc_id, n_bytes and media are read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, lo = [], 0, 0
            for k, value in enumerate(batch.column(2)):
                held.append(value.as_py())
                size += len(held[-1])
                if size >= SLICE // 2 or k == batch.num_rows - 1:
                    yield described(batch.slice(lo, k + 1 - lo), held)
                    held, size, lo = [], 0, k + 1

    def described(part: pa.RecordBatch, held: list[bytes]) -> pa.RecordBatch:
        split = [split_files(v) for v in held]
        pixels = decode_files([f for own in split for f in own])
        rows, at = [], 0
        for own, value in zip(split, held, strict=True):
            samples = np.concatenate([(p >> np.uint32(8)).astype(np.uint8).ravel() for p in pixels[at:at + len(own)]])
            at += len(own)
            raw = samples.tobytes()
            counts = np.bincount(samples, minlength=256)
            feature = f"{WIDTH}x{len(raw) // WIDTH};mean={samples.mean():.3f};distinct={np.count_nonzero(counts)};hist=" + ",".join(map(str, counts.reshape(8, 32).sum(axis=1)))
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(value), hashlib.sha256(value).hexdigest(), feature))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, fields)
