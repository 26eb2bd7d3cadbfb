"""Lossless WebP as a media column: decoding to pixel arrays, and storing bytes as pictures.

The decoder reads prefix codes (simple, normal, several groups), back-references and colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Where one group of codes of moderate length serves the picture, each pixel takes
one look at the bits ahead, which are laid out in windows of ``WINDOW`` bits; other pictures are read code by code.

The encoder stores four payload bytes a pixel (alpha, red, green, blue). It weighs each of the 14 predictors, subtract-green,
cross-colour and a palette, and in the picture that comes of it back-references and colour caches of several sizes, first by
entropy; of the forms that promise to be smaller, and of plain literals under one code, it keeps the smallest file. A predictor
or cross-colour element serves the whole picture, and there is one group of codes.

Nulls: a null text is empty, an empty one is stored as 64 zero bytes. A payload of n bytes is a picture of width 16 (wider from
16384 rows on), filled up with zero pixels; in the media column a payload of over ``PART`` bytes is several pictures one after the
other, so no size is refused and a task holds the pixels of one picture at a time. A broken file raises ValueError. Rows that
repeat get equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.blocks import utf8

WINDOW = 1 << 16
PART = 1 << 20
RUN = 1 << 18
BATCH = 8 << 20
# Pictures that are read in step: their number, and their pixels together.
LANES, TOGETHER = 512, 1 << 19
OUT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)

# Fixed values of the format: order of the code length codes, and the offsets (x, y) of short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
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
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
# Further bits and least times of the symbols that repeat a code length.
REPEATED = ((2, 3), (3, 3), (7, 11))
LONGEST, FARTHEST = 4096, 1 << 20
# What the encoder tries: the longest code word, and the sizes of a colour cache.
MOST_BITS, CACHES = 12, (7, 10)


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def between(self, start: int, end: int) -> int:
        return (int.from_bytes(self.data[start >> 3 : (end + 7) >> 3], "little") >> (start & 7)) & ((1 << (end - start)) - 1)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the picture ends early")
        value = self.peek(n)
        self.at += n
        return value


@cache
def reversal(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out, out + (1 << k)]) if k == 0 else np.concatenate([out * 2, out * 2 + 1])
    return out


# The same for the code of code lengths, as lists.
REVERSED = [reversal(n).tolist() for n in range(8)]


class Code:
    """A prefix code as tables by the next ``bits`` bits: symbol and length."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if not len(used):
            used = np.array([0])
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, used[:1].astype(np.uint16), np.zeros(1, np.uint8)
            return
        # Codes ascend by length, then symbol, when read from their first bit on.
        used = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[used]
        self.bits = int(n[-1])
        spans = 1 << (self.bits - n)
        if spans.sum() != 1 << self.bits:
            raise ValueError("a prefix code that is not complete")
        back = reversal(self.bits)
        self.symbol, self.length = np.repeat(used.astype(np.uint16), spans)[back], np.repeat(n.astype(np.uint8), spans)[back]

    def read(self, bits: Bits) -> int:
        k = bits.peek(self.bits)
        bits.at += self.length.item(k)
        return self.symbol.item(k)


def canonical(lengths: list[int]) -> dict[int, int]:
    """The code of each symbol, its first bit lowest."""
    out, code, before = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        out[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code, before = code + 1, n
    return out


def read_code(bits: Bits, alphabet: int, known: dict) -> Code:
    """The next code; ``known`` has those of this picture by their lengths, and the last one of each alphabet with its bits."""
    if alphabet in known:
        size, value, code = known[alphabet]
        # The same bits spell the same code.
        if bits.at + size <= 8 * len(bits.data) and bits.between(bits.at, bits.at + size) == value:
            bits.at += size
            return code
    start = bits.at
    lengths = read_lengths(bits, alphabet)
    name = lengths.tobytes().rstrip(b"\0")
    if name not in known:
        known[name] = Code(lengths)
    known[alphabet] = (bits.at - start, bits.between(start, bits.at), known[name])
    return known[name]


def small_table(lengths: list[int]) -> tuple[list[int], int]:
    """``Code`` for the code of code lengths: symbol and, in three bits, length by the next bits, and their mask."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [(used[0][1] if used else 0) << 3], 0
    most = used[-1][0]
    back, size, at, out = REVERSED[most], 1 << most, 0, [0] * (1 << most)
    for n, s in used:
        if at >= size:
            raise ValueError("a prefix code that is not complete")
        out[back[at] :: 1 << n] = [s << 3 | n] * (size >> n)
        at += size >> n
    if at != size:
        raise ValueError("a prefix code that is not complete")
    return out, size - 1


def read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    own, count = [0] * 19, 4 + bits.read(4)
    look = bits.between(bits.at, bits.at + 3 * count)
    bits.at += 3 * count
    for place in LENGTH_ORDER[:count]:
        own[place] = look & 7
        look >>= 3
    table, mask = small_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    out, full, at = [], 0, bits.at
    put = out.append
    ahead, base, data = 0, -256, bits.data
    while left and full < alphabet:
        left -= 1
        if at - base > 200:
            base = at & -8
            ahead = int.from_bytes(data[at >> 3 : (at >> 3) + 32], "little")
        look = ahead >> at - base
        k = table[look & mask]
        at += k & 7
        if k < 128:
            put(k >> 3)
            full += 1
            continue
        n, k = k & 7, k >> 3
        more, least = REPEATED[k - 16]
        at += more
        times = least + (look >> n & (1 << more) - 1)
        out += [next((x for x in reversed(out) if x), 8) if k == 16 else 0] * times
        full += times
    if len(out) > alphabet:
        raise ValueError("too many code lengths")
    if at > 8 * len(bits.data):
        raise ValueError("the picture ends early")
    bits.at = at
    lengths[: len(out)] = out
    return lengths


def read_value(bits: Bits, symbol: int) -> int:
    """A length or distance: its symbol and the bits behind it."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (uint32, alpha highest) as they are coded, before any transform."""
    image = begin_image(bits, width, height, main)
    return read_looking(image) if isinstance(image, Look) else image


def begin_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray | Look:
    """The pixels, or what is known of them once the codes are read."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, block, meta = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        meta = (read_image(bits, across, -(-height >> block), False).reshape(-1, across) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    known: dict = {}
    codes = [[read_code(bits, n, known) for n in sizes] for _ in range(groups)]
    # 57 bits are seen at once: four codes, or two and 10 and 18 further bits.
    if groups == 1 and sum(c.bits for c in codes[0][:4]) <= 57 and codes[0][0].bits + codes[0][4].bits <= 29:
        return Look(bits, codes[0], width, width * height, cache_bits, bits.at)
    return read_each(bits, codes, width, height, cache_bits, block, meta)


def read_each(bits: Bits, codes: list[list[Code]], width: int, height: int, cache_bits: int, block: int, meta) -> np.ndarray:
    out, count = [0] * (width * height), width * height
    cache = [0] * (1 << cache_bits) if cache_bits else None
    at = 0
    while at < count:
        group = codes[int(meta[at // width >> block, at % width >> block])] if meta is not None else codes[0]
        symbol = group[0].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            new = [alpha << 24 | red << 16 | symbol << 8 | blue]
        elif symbol < LITERALS + LENGTHS:
            length = read_value(bits, symbol - LITERALS)
            back = distance(read_value(bits, group[4].read(bits)), width)
            if back > at or at + length > count:
                raise ValueError("a back-reference leaves the picture")
            new = (out[at - back : at] * (length // back + 1))[:length]
        else:
            new = [cache[symbol - LITERALS - LENGTHS]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache is not None:
            for pixel in new:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
    return np.array(out, np.uint32)


OTHER = 1 << 40
CACHED = OTHER + (LITERALS + LENGTHS << 6)


@dataclass
class Look:
    """A picture's symbols under one group of codes, yet to be read."""

    bits: Bits
    codes: list[Code]
    width: int
    count: int
    cache_bits: int
    start: int

    def even(self) -> bool:
        """Whether every pixel is the same and takes no bits."""
        return all(c.bits == 0 for c in self.codes[:4]) and int(self.codes[0].symbol[0]) < LITERALS

    def entries(self) -> list[np.ndarray]:
        """A table for green, red, blue, alpha and distances.

        An entry is the value at its place in the pixel, and below that, in six bits, how many bits it takes: the sum of four
        entries is a pixel and its size. Lengths and distances take their further bits too.
        """
        g, *others, d = (c.symbol.astype(np.int64) for c in self.codes)
        values = [np.where(g < LITERALS, g << 14, OTHER | g << 6), *(s << 6 + place for s, place in zip(others, (16, 0, 24))), d << 6]
        values[0] += np.where((g < LITERALS) | (g >= LITERALS + LENGTHS), 0, further(g - LITERALS))
        values[4] += further(d)
        return [v + c.length for v, c in zip(values, self.codes)]


def further(symbols: np.ndarray) -> np.ndarray:
    """How many bits follow the symbols of lengths and distances."""
    return np.maximum(symbols - 2 >> 1, 0)


def read_looking(look: Look) -> np.ndarray:
    """The pixels, one look at the bits ahead for each symbol and all that belongs to it."""
    bits, width, count, cache_bits = look.bits, look.width, look.count, look.cache_bits
    if look.even():
        green, red, blue, alpha = (int(c.symbol[0]) for c in look.codes[:4])
        return np.full(count, alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    g, r, b, a, d = (memoryview(e) if count < len(e) else e.tolist() for e in look.entries())
    gm, rm, bm, am, dm = ((1 << c.bits) - 1 for c in look.codes)
    slots, shift = ([0] * (1 << cache_bits) if cache_bits else None), 32 - cache_bits
    out: list[int] = []
    append, at, done = out.append, 0, 0
    p, size = bits.at, 8 * len(bits.data)
    while at < count:
        first, piece = p >> 3, bits.data[p >> 3 : (p >> 3) + WINDOW // 8 + 8]
        # The 64 bits from each byte on.
        ahead = np.ndarray((len(piece) + 1,), "<u8", piece + bytes(8), 0, (1,)).tolist()
        base, q = 8 * first, p & 7
        end = 8 * (len(piece) - 7) if first + len(piece) < len(bits.data) else 8 * len(piece) + 1
        if q >= end:
            raise ValueError("the picture ends early")
        while q < end and at < count:
            v = ahead[q >> 3] >> (q & 7)
            e = g[v & gm]
            if e < OTHER:
                v >>= e & 63
                f = r[v & rm]
                v >>= f & 63
                h = b[v & bm]
                e += f + h + a[v >> (h & 63) & am]
                q += e & 63
                append(e >> 6)
                at += 1
                continue
            n = e & 63
            e = e - OTHER >> 6
            if e >= LITERALS + LENGTHS:
                q += n
                for pixel in out[done:]:
                    slots[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
                done = at
                append(slots[e - LITERALS - LENGTHS])
                at += 1
                continue
            length = e - LITERALS
            if length >= 4:
                k = length - 2 >> 1
                length = (2 + (length & 1) << k) + (v >> n - k & (1 << k) - 1)
            length += 1
            v >>= n
            e = d[v & dm]
            m = e & 63
            n += m
            back = e >> 6
            if back >= 4:
                k = back - 2 >> 1
                back = (2 + (back & 1) << k) + (v >> m - k & (1 << k) - 1)
            q += n
            back = distance(back + 1, width)
            if back > at or at + length > count:
                raise ValueError("a back-reference leaves the picture")
            out += out[at - back : at - back + length] if back >= length else (out[at - back :] * (length // back + 1))[:length]
            at += length
        p = base + q
        if p > size:
            raise ValueError("the picture ends early")
    bits.at = p
    return np.array(out, np.uint32)


def read_in_step(looks: list[Look]) -> list[np.ndarray]:
    """The pixels of many pictures: the next symbol of each is read at the same time."""
    lanes, masks, tables, size, piece_at, pieces = len(looks), [], [], 0, 0, []
    starts, begins = np.zeros((5, lanes), np.int64), np.zeros(lanes, np.int64)
    for k, look in enumerate(looks):
        for c, entries in enumerate(look.entries()):
            starts[c, k] = size
            size += len(entries)
            tables.append(entries)
        masks.append([(1 << c.bits) - 1 for c in look.codes])
        begins[k] = 8 * piece_at + look.bits.at
        pieces.append(look.bits.data)
        piece_at += len(look.bits.data)
    table, masks = np.concatenate(tables), np.array(masks).T
    data = b"".join(pieces)
    ends = 8 * np.cumsum([len(x) for x in pieces])
    # The 64 bits from each byte on; pictures whose data has ended stay there.
    ahead = np.ascontiguousarray(np.ndarray((len(data) + 8,), "<i8", data + bytes(16), 0, (1,)))
    counts = np.array([x.count for x in looks])
    tokens = np.zeros((int(counts.max()) + 16, lanes), np.int64)
    live, q, where, mask, stop, step = np.arange(lanes), begins, starts, masks, ends, 0
    while len(live):
        v = ahead[q >> 3] >> (q & 7)
        e = table[where[0] + (v & mask[0])]
        other = np.flatnonzero(e >= OTHER)
        w = v >> (e & 63)
        f = table[where[1] + (w & mask[1])]
        w >>= f & 63
        h = table[where[2] + (w & mask[2])]
        w >>= h & 63
        h += e
        h += f
        h += table[where[3] + (w & mask[3])]
        taken = h & 63
        h >>= 6
        if len(other):
            e = e[other]
            taken[other], h[other] = e & 63, -1 - q[other]
            refs = np.flatnonzero(e < CACHED)
            if len(refs):
                other = other[refs]
                taken[other] += table[where[4][other] + (v[other] >> (e[refs] & 63) & mask[4][other])] & 63
        tokens[step, live] = h
        q = q + taken
        step += 1
        if step % 16 == 0 or step == len(tokens):
            # A picture's symbols end with its data, or what comes after its pixels is cut off later.
            keep = np.flatnonzero((q < stop) & (step < counts[live]))
            live, q, where, mask, stop = live[keep], q[keep], where[:, keep], mask[:, keep], stop[keep]
        else:
            np.minimum(q, stop, out=q)
    tokens = tokens[:step].T
    # Lengths, distances and cache symbols, read when all places are known.
    lane, column = np.nonzero(tokens < 0)
    q = -1 - tokens[lane, column]
    v = ahead[q >> 3] >> (q & 7)
    e = table[starts[0][lane] + (v & masks[0][lane])]
    x = (e - OTHER >> 6) - LITERALS
    value = LENGTHS - 1 - x
    refs = np.flatnonzero(x < LENGTHS)
    x, owner, v, n = x[refs], lane[refs], v[refs], e[refs] & 63
    k = further(x)
    length = np.where(x < 4, x, (2 + (x & 1) << k) + (v >> n - k & (1 << k) - 1)) + 1
    v >>= n
    x = table[starts[4][owner] + (v & masks[4][owner])]
    n, x = x & 63, x >> 6
    k = further(x)
    value[refs] = -((np.where(x < 4, x, (2 + (x & 1) << k) + (v >> n - k & (1 << k) - 1)) + 1) << 20 | length)
    tokens[lane, column] = value
    return resolved(tokens, looks, counts)


def resolved(tokens: np.ndarray, looks: list[Look], counts: np.ndarray) -> list[np.ndarray]:
    """The pixels that rows of tokens stand for."""
    gone = np.where(tokens < -(1 << 20), -tokens & (1 << 20) - 1, 1)
    sums = np.cumsum(gone, axis=1)
    valid = sums <= counts[:, None]
    if not (np.where(valid, sums, 0).max(axis=1) == counts).all():
        # A broken file: read alone it says what is wrong.
        return [read_looking(x) for x in looks]
    lane, tokens, gone = np.nonzero(valid)[0], tokens[valid], gone[valid]
    n, first = int(counts.sum()), np.cumsum(counts) - counts
    begin = np.cumsum(gone) - gone
    # Where each pixel is copied from; literals and cache symbols are their own source.
    source, value = np.arange(n), np.zeros(n, np.int64)
    refs = np.flatnonzero(tokens < -(1 << 20))
    value[begin] = tokens
    if len(refs):
        codes, widths = -tokens[refs] >> 20, np.array([x.width for x in looks])[lane[refs]]
        near = np.array([(0, 0), *NEAR])[np.minimum(codes, len(NEAR))]
        back = np.where(codes > len(NEAR), codes - len(NEAR), np.maximum(near[:, 0] + near[:, 1] * widths, 1))
        if (begin[refs] - back < first[lane[refs]]).any():
            raise ValueError("a back-reference leaves the picture")
        copied = np.repeat(begin[refs] - back, gone[refs])
        copied += np.arange(len(copied)) - np.repeat(np.cumsum(gone[refs]) - gone[refs], gone[refs])
        source[np.repeat(begin[refs], gone[refs]) + copied - np.repeat(begin[refs] - back, gone[refs])] = copied
        source = followed(source)
    bits = np.array([x.cache_bits for x in looks])
    if bits.any():
        picture = np.repeat(np.arange(len(looks)), counts)
        literal = (value >= 0) & (source == np.arange(n))
        slot = np.where(literal, (value * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - bits[picture], -value - 1)[source]
        cached = np.flatnonzero(value[source] < 0)
        cached = cached[source[cached] == cached]
        places, before = latest(picture << 11 | slot)
        earlier = np.full(n, -1)
        earlier[places] = before
        # A slot begins with pixel 0, whose own slot is 0.
        new = cached[earlier[cached] < 0]
        if slot[new].any():
            return [read_again(x) for x in looks]
        value[new] = 0
        cached = cached[earlier[cached] >= 0]
        origin = np.arange(n)
        origin[cached] = source[earlier[cached]]
        source = followed(origin)[source]
    return np.split(value[source].astype(np.uint32), np.cumsum(counts)[:-1])


def read_again(look: Look) -> np.ndarray:
    look.bits.at = look.start
    return read_looking(look)


def followed(source: np.ndarray) -> np.ndarray:
    """The last source of each place."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def read_group(looks: list[Look]) -> list[np.ndarray]:
    """The pixels of pictures, in step if there are enough of them."""
    out: list = [None] * len(looks)
    in_step = [k for k, x in enumerate(looks) if not x.even()]
    if 10 * len(in_step) >= LANES:
        for k, pixels in zip(in_step, read_in_step([looks[k] for k in in_step])):
            out[k] = pixels
    return [read_looking(x) if pixels is None else pixels for x, pixels in zip(looks, out)]


def split(pixels: np.ndarray) -> np.ndarray:
    """Channels alpha, red, green, blue as the last axis, int32."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def join(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _select(left, top, corner):
    guess = left + top - corner
    return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top


def predicted(mode: int, left, top, corner, right):
    """What each of the 14 modes expects (arrays of the four channels)."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0], np.int32)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right) // 2 + top) // 2
    if mode <= 9:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return (a + b) // 2
    if mode == 10:
        return ((left + corner) // 2 + (top + right) // 2) // 2
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    middle = (left + top) // 2
    # Division that rounds towards zero.
    return np.clip(middle + np.trunc((middle - corner) / 2).astype(np.int32), 0, 255)


def undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    rest = split(pixels.reshape(-1, width))
    if (modes == modes[0, 0]).all() and int(modes[0, 0]) in (0, 1, 2, 3, 4, 8, 9):
        return undo_rows(rest, int(modes[0, 0]))
    flat = rest.reshape(-1, 4)
    for y in range(rest.shape[0]):
        for x in range(width):
            i = y * width + x
            if y == 0:
                guess = flat[i - 1] if x else np.array([255, 0, 0, 0], np.int32)
            elif x == 0:
                guess = flat[i - width]
            else:
                guess = predicted(int(modes[y >> block, x >> block]), flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
            flat[i] = (flat[i] + guess) & 255
    return join(flat)


def undo_rows(c: np.ndarray, mode: int) -> np.ndarray:
    """One mode for the whole picture, which needs the row above or the pixel to the left alone."""
    c[0, 0, 0] += 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    c[:, 0] = np.cumsum(c[:, 0], axis=0) & 255
    if mode == 0:
        c[1:, 1:, 0] += 255
    elif mode == 1:
        c[1:] = np.cumsum(c[1:], axis=1)
    elif mode == 2:
        c[:, 1:] = np.cumsum(c[:, 1:], axis=0)
    else:
        for y in range(1, len(c)):
            corner, top = c[y - 1, :-1], c[y - 1, 1:]
            right = np.concatenate([c[y - 1, 2:], c[y, :1]])
            guess = right if mode == 3 else corner if mode == 4 else (corner + top) // 2 if mode == 8 else (top + right) // 2
            c[y, 1:] = (c[y, 1:] + guess[: len(top)]) & 255
    return join(c & 255).ravel()


def shift(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def undo_cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, block: int) -> np.ndarray:
    c = split(pixels.reshape(-1, width))
    y, x = np.arange(c.shape[0]) >> block, np.arange(width) >> block
    e = split(elements)[y][:, x]
    red_to_blue, green_to_blue, green_to_red = e[..., 1], e[..., 2], e[..., 3]
    c[..., 1] = (c[..., 1] + shift(green_to_red, c[..., 2])) & 255
    c[..., 3] = (c[..., 3] + shift(green_to_blue, c[..., 2]) + shift(red_to_blue, c[..., 1])) & 255
    return join(c).ravel()


def undo_palette(pixels: np.ndarray, width: int, coded_width: int, palette: np.ndarray, packed: int) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(-1, coded_width)
    each = 8 >> packed
    parts = (index[..., None] >> (each * np.arange(1 << packed, dtype=np.uint32))) & np.uint32((1 << each) - 1)
    index = parts.reshape(index.shape[0], -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index].ravel()


def decode(file: bytes) -> np.ndarray:
    """The pixels of a file, uint32 (alpha, red, green, blue from the highest byte), as (height, width)."""
    image, finish = begin(file)
    return finish(read_looking(image) if isinstance(image, Look) else image)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` for many files; those of about a size are read together."""
    out: list = [None] * len(files)
    # Width and height less 1 are the first 28 bits.
    heads = [int.from_bytes(x[21:25], "little") for x in files]
    order = sorted((((x & 0x3FFF) + 1) * ((x >> 14 & 0x3FFF) + 1), k) for k, x in enumerate(heads))
    at = 0
    while at < len(order):
        end, most = at + 1, 2 * order[at][0] + 256
        while end < len(order) and end - at < LANES and order[end][0] <= most and (end + 1 - at) * order[end][0] <= TOGETHER:
            end += 1
        group = [k for _, k in order[at:end]]
        begun = [begin(files[k]) for k in group]
        pixels = iter(read_group([image for image, _ in begun if isinstance(image, Look)]))
        for k, (image, finish) in zip(group, begun):
            out[k] = finish(next(pixels) if isinstance(image, Look) else image)
        at = end
    return out


def begin(file: bytes) -> tuple[np.ndarray | Look, Callable[[np.ndarray], np.ndarray]]:
    """What comes before the pixels of a file: these as yet coded, and what makes a picture of them."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or len(file) < 25 or file[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[21 : 20 + struct.unpack("<I", file[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, coded, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform that comes twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            across = -(-coded >> block)
            side = read_image(bits, across, -(-height >> block), False).reshape(-1, across)
            if kind == 0:
                modes = (side >> np.uint32(8)) & np.uint32(15)
                undo.append(lambda p, w=coded, m=modes, b=block: undo_predictor(p, w, m, b))
            else:
                undo.append(lambda p, w=coded, e=side, b=block: undo_cross_colour(p, w, e, b))
        elif kind == 2:

            def add_green(p: np.ndarray) -> np.ndarray:
                c = split(p)
                c[..., 1] += c[..., 2]
                c[..., 3] += c[..., 2]
                return join(c)

            undo.append(add_green)
        else:
            size = bits.read(8) + 1
            palette = join(np.cumsum(split(read_image(bits, size, 1, False)), axis=0))
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            narrow = -(-coded >> packed)
            undo.append(lambda p, w=coded, n=narrow, t=palette, b=packed: undo_palette(p, w, n, t, b))
            coded = narrow

    def finish(pixels: np.ndarray) -> np.ndarray:
        for step in reversed(undo):
            pixels = step(pixels)
        return pixels.reshape(height, width)

    return begin_image(bits, coded, height, True), finish


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; a lone symbol gets 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.int64)
    order = np.argsort(weights, kind="stable")
    lengths[used[order]] = huffman(weights[order].tolist(), most)
    return lengths


NONE = 1 << 62


def huffman(weights: list[int], most: int) -> list[int]:
    """Code lengths of two or more ascending weights."""
    n, least = len(weights), 0
    while True:
        # Leaves by weight, then the inner nodes, which come into being in order of weight.
        node, parent, made = weights + [NONE], [0] * (2 * n - 1), []
        put, leaf, inner, low, high = made.append, 0, 0, weights[0], NONE
        for new in range(n, 2 * n - 1):
            if low <= high:
                total = low
                parent[leaf] = new
                leaf += 1
                low = node[leaf]
            else:
                total = high
                parent[n + inner] = new
                inner += 1
                high = made[inner] if inner < len(made) else NONE
            if low <= high:
                total += low
                parent[leaf] = new
                leaf += 1
                low = node[leaf]
            else:
                total += high
                parent[n + inner] = new
                inner += 1
                high = made[inner] if inner < len(made) else NONE
            put(total)
            if high == NONE:
                high = made[inner]
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:
            return depth[:n]
        # Rare symbols count as less rare.
        least = 2 * least or max(2, sum(weights) >> most)
        weights = [max(w, least) for w in weights]


def codewords(lengths: np.ndarray) -> np.ndarray:
    """``canonical`` as an array; a lone symbol takes no bits."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        used = used[np.argsort(lengths[used], kind="stable")]
        most = int(lengths[used[-1]])
        spans = 1 << (most - lengths[used])
        out[used] = reversal(most)[np.cumsum(spans) - spans]
    return out


@cache
def zeros(n: int) -> list[int]:
    """Tokens of n code lengths of 0."""
    if n > 138:
        return zeros(138) + zeros(n - 138)
    return [18 | n - 11 << 5] if n >= 11 else [17 | n - 3 << 5] if n >= 3 else [0] * n


class Writer:
    """Collects bits, least significant first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_code(self, lengths: np.ndarray) -> None:
        """The code lengths of an alphabet, up to the last one that isn't 0: the same bits for any larger alphabet."""
        used = np.flatnonzero(lengths)
        if len(used) <= 2 and (not len(used) or used[-1] < 256):
            symbols = used.tolist() or [0]
            self.put(1, 1)
            self.put(len(symbols) - 1, 1)
            self.put(1, 1)
            for s in symbols:
                self.put(s, 8)
            return
        # A token is its symbol and, from bit 5 on, what its further bits say.
        tokens: list[int] = []
        at = 0
        for place, n in zip(used.tolist(), lengths[used].tolist()):
            if place > at:
                tokens += zeros(place - at)
            tokens.append(n)
            at = place + 1
        counts = [0] * 19
        for t in tokens:
            counts[t & 31] += 1
        order = sorted((n, s) for s, n in enumerate(counts) if n)
        if len(order) == 1:
            order.append((0, 0 if order[0][1] else 1))
        sizes = [0] * 19
        for (_, s), n in zip(order, huffman([n for n, _ in order], 7)):
            sizes[s] = n
        codes, most, at = [0] * 19, max(sizes), 0
        back = REVERSED[most]
        for n, s in sorted((n, s) for s, n in enumerate(sizes) if n):
            codes[s] = back[at]
            at += 1 << most - n
        count = max(4, max(i + 1 for i, s in enumerate(LENGTH_ORDER) if sizes[s]))
        self.put(0, 1)
        self.put(count - 4, 4)
        for s in LENGTH_ORDER[:count]:
            self.put(sizes[s], 3)
        self.put(1, 1)
        wide = 4 if len(tokens) - 2 < 1024 else 5
        self.put(wide, 3)
        self.put(len(tokens) - 2, 2 + 2 * wide)
        value, size = 0, 0
        for t in tokens:
            if t < 16:
                value |= codes[t] << size
                size += sizes[t]
            else:
                s = t & 31
                value |= (codes[s] | t >> 5 << sizes[s]) << size
                size += sizes[s] + REPEATED[s - 16][0]
        self.put(value, size)

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


def wrap(stream: bytes) -> bytes:
    """The file around a stream that begins with its signature byte."""
    pad = b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def size_of(payload_bytes: int) -> tuple[int, int]:
    pixels = payload_bytes // 4
    width = 16 * max(1, -(-pixels // (16 * 16384)))
    return width, -(-pixels // width)


CHANNELS = np.arange(0, 1024, 256)
# n * log2(n), to be looked up.
WEIGHT = np.arange(1 << 14) * np.log2(np.maximum(np.arange(1 << 14), 1))


def entropy(counts: np.ndarray) -> np.ndarray:
    """For each row of counts about how many bits the symbols take, and their code in the file."""
    totals, each = counts.sum(axis=-1), WEIGHT[np.minimum(counts, len(WEIGHT) - 1)]
    if (large := counts >= len(WEIGHT)).any():
        each[large] = counts[large] * np.log2(counts[large])
    return totals * np.log2(np.maximum(totals, 1)) - each.sum(axis=-1) + 5 * np.count_nonzero(counts, axis=-1)


def literal_bits(channels: np.ndarray) -> float:
    """About what the pixels (bytes, four a pixel) take as literals, each channel under a code of its own."""
    return float(entropy(np.bincount((channels + CHANNELS).ravel(), minlength=1024).reshape(4, 256)).sum())


def bytes_of(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red and alpha of each pixel."""
    return pixels.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)


def pixels_of(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4").ravel()


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def residuals(c: np.ndarray, width: int, starts: np.ndarray) -> Iterator[np.ndarray]:
    """What each of the 14 predictors leaves of pictures in a row (bytes) that begin at the given pixels."""

    def before(n: int) -> np.ndarray:
        return np.concatenate([c[len(c) - n :], c[: len(c) - n]])

    black = np.array([0, 0, 0, 255], np.uint8)
    left, top, corner, right = before(1), before(width), before(width + 1), before(width - 1)
    tops = (starts[:, None] + np.arange(width)).ravel()
    edge, side = c[tops] - left[tops], c[::width] - top[::width]
    edge[::width] = side[starts // width] = c[starts] - black

    def expected(mode: int) -> np.ndarray:
        if mode < 5:
            return (black, left, top, right, corner)[mode]
        if mode == 5:
            return average(average(left, right), top)
        if mode < 10:
            return average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
        if mode == 10:
            return average(average(left, corner), average(top, right))
        x, y, z = (v.astype(np.int16) for v in (left, top, corner))
        if mode == 11:
            nearer = np.abs(y - z).sum(axis=1) < np.abs(x - z).sum(axis=1)
            return np.where(nearer[:, None], left, top)
        if mode == 12:
            return np.clip(x + y - z, 0, 255).astype(np.uint8)
        middle = (x + y) >> 1
        off = middle - z
        return np.clip(middle + (off + (off < 0) >> 1), 0, 255).astype(np.uint8)

    for mode in range(14):
        rest = c - expected(mode)
        rest[tops] = edge
        rest[::width] = side
        yield rest


def factors(of: np.ndarray, by: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each picture the factor (in 32nds) that takes most of one channel's variation out of another, by least squares."""
    of, by = of.view(np.int8).astype(np.int64), by.view(np.int8).astype(np.int64)
    product, square = np.add.reduceat(of * by, starts), np.add.reduceat(by * by, starts)
    return np.clip(np.rint(32 * product / np.maximum(square, 1)), -128, 127).astype(np.int64)


def cross_colour(c: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An element for each whole picture and what it leaves."""
    blue, green, red = (np.ascontiguousarray(c[:, k]) for k in range(3))

    def less(channel: np.ndarray, factor: np.ndarray, by: np.ndarray) -> np.ndarray:
        return channel - (np.repeat(factor, counts) * by.view(np.int8) >> 5).astype(np.uint8)

    rest = c.copy()
    green_to_red, green_to_blue = factors(red, green, starts), factors(blue, green, starts)
    rest[:, 2] = less(red, green_to_red, green)
    blue = less(blue, green_to_blue, green)
    red_to_blue = factors(blue, red, starts)
    rest[:, 0] = less(blue, red_to_blue, red)
    return 0xFF000000 | (red_to_blue & 255) << 16 | (green_to_blue & 255) << 8 | green_to_red & 255, rest


@cache
def near_codes(width: int) -> np.ndarray:
    """The code of each distance: the smallest of the short ones, if one fits."""
    out = np.arange(7 * width + 9) + len(NEAR)
    for k in range(len(NEAR), 0, -1):
        out[distance(k, width)] = k
    return out


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of further bits and these bits of lengths or distance codes: the reverse of ``read_value``."""
    v = values - 1
    more = np.maximum(np.frexp(v.astype(float))[1] - 2, 0)
    more[v < 4] = 0
    return np.where(v < 4, v, 2 * more + 2 + (v >> more & 1)), more, np.where(v < 4, 0, v & (1 << more) - 1)


def latest(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key (of up to 40 bits) was there before, and the latest such place."""
    by = len(key).bit_length()
    # Sorting numbers is far cheaper than sorting places by numbers.
    key = np.sort(key.astype(np.uint64) << np.uint64(by) | np.arange(len(key), dtype=np.uint64))
    same = np.flatnonzero(key[1:] >> np.uint64(by) == key[:-1] >> np.uint64(by))
    mask = np.uint64((1 << by) - 1)
    return (key[same + 1] & mask).astype(np.int64), (key[same] & mask).astype(np.int64)


def repeats(pixels: np.ndarray, picture: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Back-references (place, distance, length), taken in each picture from the left.

    They go to the latest place of the same two pixels, and as far as these places go on alike.
    """
    n = len(pixels)
    pair = pixels[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pixels[1:]
    pair = (pair ^ pair >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 40)
    places, before = latest(pair)
    fits = (picture[places + 1] == picture[before]) & (pixels[places] == pixels[before]) & (pixels[places + 1] == pixels[before + 1])
    fits &= places - before <= FARTHEST - len(NEAR)
    places, before = places[fits], before[fits]
    sort = np.argsort(places)
    value, out, free = pixels.tolist(), [], 0
    for i, j, end in zip(places[sort].tolist(), before[sort].tolist(), ends[picture[places[sort]]].tolist()):
        if i < free:
            continue
        # Pieces are compared as wholes, then pixels.
        free, most, by, d = i + 2, min(end, i + LONGEST), 16, i - j
        while free + by <= most and value[free : free + by] == value[free - d : free - d + by]:
            free += by
            by *= 2
        while free < most and value[free] == value[free - d]:
            free += 1
        out.append((i, d, free - i))
    return np.array(out, np.int64).reshape(-1, 3)


def hits(pixels: np.ndarray, cache_bits: int, picture: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot of each pixel in the colour cache of its picture, whether it is there when its turn comes, and each picture's slots in use."""
    slot = (pixels * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int64)
    places, before = latest(picture << cache_bits | slot)
    # A slot begins with pixel 0.
    found = pixels == 0
    found[places] = pixels[places] == pixels[before]
    return slot, found, np.bincount(picture, minlength=len(starts)) - np.bincount(picture[places], minlength=len(starts))


REST = LITERALS + LENGTHS + (1 << CACHES[-1])
SYMBOLS = REST + 3 * 256 + DISTANCES


def images(all_pixels: list[np.ndarray], width: int, main: bool) -> list[Writer]:
    """Each picture as it stands in a file: size of the colour cache, codes, and symbols."""
    k, counts = len(all_pixels), np.array([len(x) for x in all_pixels])
    pixels, ends = np.concatenate(all_pixels), np.cumsum(counts)
    starts, picture, n = ends - counts, np.repeat(np.arange(k), counts), len(pixels)
    channels = bytes_of(pixels)
    refs = repeats(pixels, picture, ends)
    at, far, length = refs.T
    edge = np.zeros(n + 1, np.int8)
    edge[at] = 1
    edge[at + length] -= 1
    free = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
    near = near_codes(width)
    lengths = prefixed(length)
    distances = prefixed(np.where(far < len(near), near[np.minimum(far, len(near) - 1)], far + len(NEAR)))
    owner, home = picture[at], picture[free]
    distance_counts = np.bincount(owner * DISTANCES + distances[0], minlength=k * DISTANCES).reshape(k, DISTANCES)
    length_counts = np.bincount(owner * LENGTHS + lengths[0], minlength=k * LENGTHS).reshape(k, LENGTHS)
    # Each size of the colour cache is counted, and none.
    green, rest_places = channels[free, 1].astype(np.int64), channels[free][:, [2, 0, 3]] + CHANNELS[:3]
    ways = []
    for cache_bits in (0, *CACHES):
        symbol, there = green, np.zeros(len(free), bool)
        if cache_bits:
            slot, found, _ = hits(pixels, cache_bits, picture, starts)
            there = found[free]
            symbol = np.where(there, slot[free] + LITERALS + LENGTHS, green)
        size = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
        green_counts = np.bincount(home * size + symbol, minlength=k * size).reshape(k, size)
        green_counts[:, LITERALS : LITERALS + LENGTHS] = length_counts
        literal = np.flatnonzero(~there)
        rest_counts = np.bincount((rest_places[literal] + (home[literal] * 768)[:, None]).ravel(), minlength=k * 768).reshape(k, 3, 256)
        # One code for red, blue and alpha, written three times, unless their own ones save a twelfth.
        both = rest_counts.sum(axis=1)
        joint, own = entropy(both) + 10 * np.count_nonzero(both, axis=1), entropy(rest_counts).sum(axis=1)
        alike = 11 * joint <= 12 * own
        ways.append((entropy(green_counts) + np.where(alike, joint, own), cache_bits, symbol, there, green_counts, rest_counts, alike))
    best = np.argmin([w[0] for w in ways], axis=0)
    code, size = np.zeros((k, SYMBOLS), np.uint64), np.zeros((k, SYMBOLS), np.int64)
    out = []
    for p, way in enumerate(best.tolist()):
        _, cache_bits, _, _, green_counts, rest_counts, alike = ways[way]
        head = Writer()
        head.put(int(cache_bits > 0), 1)
        if cache_bits:
            head.put(cache_bits, 4)
        if main:
            head.put(0, 1)
        rest = [rest_counts[p].sum(axis=0)] if alike[p] else rest_counts[p]
        places = (0, *range(REST, REST + 256 * len(rest), 256), REST + 768)
        for place, c in zip(places, (green_counts[p], *rest, distance_counts[p])):
            sizes = code_lengths(c, MOST_BITS)
            once = Writer()
            once.put_code(sizes)
            for _ in range(3 if place == REST and alike[p] else 1):
                head.put(once.value, once.size)
            # A lone symbol takes no bits.
            if np.count_nonzero(sizes) > 1:
                size[p, place : place + len(sizes)] = sizes
                code[p, place : place + len(sizes)] = codewords(sizes)
        if alike[p]:
            for place in (REST + 256, REST + 512):
                size[p, place : place + 256], code[p, place : place + 256] = size[p, REST : REST + 256], code[p, REST : REST + 256]
        out.append(head)
    # The order within a pixel is green, red, blue, alpha; what belongs together is one value, at the place where it begins.
    code, size = code.ravel(), size.ravel()
    way = best[home]
    symbol, there = (np.choose(way, [w[k] for w in ways]) for k in (2, 3))
    value, bits = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    v, b = code[home * SYMBOLS + symbol], size[home * SYMBOLS + symbol]
    literal = np.flatnonzero(~there)
    lv, lb, base = v[literal], b[literal], home[literal] * SYMBOLS + REST
    for channel in range(3):
        place = base + rest_places[literal, channel]
        lv |= code[place] << lb.astype(np.uint64)
        lb += size[place]
    v[literal], b[literal] = lv, lb
    value[free], bits[free] = v, b
    v, b = code[owner * SYMBOLS + LITERALS + lengths[0]], size[owner * SYMBOLS + LITERALS + lengths[0]]
    place = owner * SYMBOLS + REST + 768 + distances[0]
    for more, m in ((lengths[2].astype(np.uint64), lengths[1]), (code[place], size[place]), (distances[2].astype(np.uint64), distances[1])):
        v |= more << b.astype(np.uint64)
        b += m
    value[at], bits[at] = v, b
    # The symbols of each picture begin in a word of their own.
    total = np.add.reduceat(bits, starts)
    words_of = total // 64 + 2
    first_word = np.cumsum(words_of) - words_of
    begin = np.cumsum(bits) - bits
    begin += np.repeat(64 * first_word - begin[starts], counts)
    words = np.zeros(int(words_of.sum()), "<u8")
    word, by = begin >> 6, (begin & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(value << by, first)
    over = np.flatnonzero((begin & 63) + bits > 64)
    words[word[over] + 1] |= value[over] >> (np.uint64(64) - by[over])
    for head, lo, w, b in zip(out, first_word.tolist(), words_of.tolist(), total.tolist()):
        head.put(int.from_bytes(words[lo : lo + w].tobytes(), "little"), b)
    return out


def constant(out: Writer, pixel: int) -> None:
    """A side image of one colour."""
    out.put(0, 1)
    for s in (pixel >> 8 & 255, pixel >> 16 & 255, pixel & 255, pixel >> 24, 0):
        for value, n in ((1, 1), (0, 1), (1, 1), (s, 8)):
            out.put(value, n)


def promising(channels: np.ndarray, width: int, starts: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each picture the transforms (kind, element, what is left) with two fifths of all bytes left within 2 of 0."""
    out = [[] for _ in starts]
    spans = list(zip(starts.tolist(), (starts + counts).tolist()))

    def weigh(kind: int, elements: list[int], rest: np.ndarray) -> None:
        close = (rest + np.uint8(2) <= np.uint8(4)).ravel()
        for k, (lo, hi) in enumerate(spans):
            if 10 * np.count_nonzero(close[4 * lo : 4 * hi]) >= 16 * (hi - lo):
                out[k].append((kind, elements[k], rest[lo:hi]))

    greenless = channels.copy()
    greenless[:, [0, 2]] -= channels[:, 1:2]
    weigh(2, [0] * len(spans), greenless)
    elements, rest = cross_colour(channels, starts, counts)
    weigh(1, elements.tolist(), rest)
    for mode, rest in enumerate(residuals(channels, width, starts)):
        weigh(0, [0xFF000000 | mode << 8] * len(spans), rest)
    return out


def transformed(channels: np.ndarray, kinds: list[tuple[int, int, np.ndarray]], width: int) -> Writer | None:
    """A picture after that transform which leaves the least, as far as literals tell, if this is less than the pixels themselves."""
    least, k = min((literal_bits(rest), k) for k, (_, _, rest) in enumerate(kinds))
    if least >= literal_bits(channels):
        return None
    kind, pixel, rest = kinds[k]
    out = Writer()
    out.put(1, 1)
    out.put(kind, 2)
    if kind < 2:
        # Blocks of 512 pixels, all with this element.
        out.put(7, 3)
        constant(out, pixel)
    out.put(0, 1)
    [image] = images([pixels_of(rest)], width, True)
    out.put(image.value, image.size)
    return out


def palette(pixels: np.ndarray, width: int, least: int) -> Writer | None:
    """A picture as places in a palette, if it has at most 256 colours, each twice on average, and may take less than ``least`` bits."""
    colours, index = np.unique(pixels, return_inverse=True)
    if len(colours) > min(256, len(pixels) // 2):
        return None
    out = Writer()
    for value, n in ((1, 1), (3, 2), (len(colours) - 1, 8)):
        out.put(value, n)
    steps = pixels_of(np.diff(bytes_of(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)))
    packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    # Back-references take less than the places one by one; a quarter is more than they saved on any text tried.
    if not packed and literal_bits(bytes_of(steps)) + 0.75 * entropy(np.bincount(index)) > least:
        return None
    parts = index.reshape(-1, 1 << packed).astype(np.uint32) << np.arange(0, 8, 8 >> packed, dtype=np.uint32)
    index = np.bitwise_or.reduce(parts, axis=1) << np.uint32(8) | np.uint32(0xFF000000)
    [colours], [image] = images([steps], len(steps), False), images([index], width >> packed, True)
    for value, n in ((colours.value, colours.size), (0, 1), (image.value, image.size)):
        out.put(value, n)
    return out


def encode_all(payloads: list[np.ndarray], width: int) -> list[bytes]:
    """A file for each payload; all are stored as pictures of this width."""
    all_pixels = []
    for payload in payloads:
        padded = np.zeros(-(-len(payload) // (4 * width)) * 4 * width, np.uint8)
        padded[: len(payload)] = payload
        all_pixels.append(padded.view(">u4").astype("<u4"))
    counts = np.array([len(x) for x in all_pixels])
    starts = np.cumsum(counts) - counts
    channels = bytes_of(np.concatenate(all_pixels))
    files = []
    plain, kinds_of = images(all_pixels, width, True), promising(channels, width, starts, counts)
    # There are at least as many colours as slots in use.
    *_, slots = hits(np.concatenate(all_pixels), CACHES[-1], np.repeat(np.arange(len(counts)), counts), starts)
    few = slots <= np.minimum(256, counts // 2)
    for pixels, start, image, kinds, some in zip(all_pixels, starts.tolist(), plain, kinds_of, few.tolist()):
        forms = [Writer(), palette(pixels, width, image.size) if some else None]
        forms[0].put(image.value << 1, image.size + 1)
        if kinds:
            forms.append(transformed(channels[start : start + len(pixels)], kinds, width))
        form = min((f for f in forms if f), key=lambda f: f.size)
        out = Writer()
        for value, n in ((0x2F, 8), (width - 1, 14), (len(pixels) // width - 1, 14), (1, 1), (0, 3), (form.value, form.size)):
            out.put(value, n)
        files.append(wrap(out.bytes()))
    return files


def encode(payload: np.ndarray) -> bytes:
    """One file whose pixels are the payload (bytes, a multiple of 64, up to 1 GiB; ``pictures`` takes any size)."""
    width, _ = size_of(len(payload))
    if width > 16384:
        raise ValueError("a payload of over 1 GiB is several pictures")
    return encode_all([payload], width)[0]


def payload_of(text: np.ndarray) -> np.ndarray:
    out = np.zeros(max(64, -(-len(text) // 64) * 64), np.uint8)
    out[: len(text)] = text
    return out


def payload_from(pixels: np.ndarray, payload_bytes: int) -> np.ndarray:
    return pixels.astype(">u4").reshape(-1).view(np.uint8)[:payload_bytes]


def pictures(payloads: list[np.ndarray]) -> Iterator[bytes]:
    """The media of each payload: a file, or several one after the other if it has over ``PART`` bytes."""
    parts = [[p[lo : lo + PART] for lo in range(0, len(p), PART)] for p in payloads]
    run, files = [], []
    flat = [p for x in parts for p in x]
    for k, part in enumerate(flat):
        run.append(part)
        if k + 1 == len(flat) or sum(map(len, run)) + len(flat[k + 1]) > RUN:
            files += encode_all(run, size_of(PART)[0])
            run = []
    at = 0
    for x in parts:
        yield b"".join(files[at : at + len(x)])
        at += len(x)


def files_of(media: bytes) -> list[bytes]:
    """The files that stand one after the other."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows in a row of about ``BATCH`` bytes, a larger one by itself."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + BATCH, "right")))
        yield lo, hi
        lo = hi


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text as pictures (``media``) of each row of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in portions(np.diff(at)):
                media = list(pictures([payload_of(data[at[k] : at[k + 1]]) for k in range(lo, hi)]))
                columns = [batch.column(0)[lo:hi], pa.array(np.diff(at[lo : hi + 1])), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """Digests and a feature (size and mean of each channel) of what the pictures hold."""

    def features(n: int, file: bytes, shown: list[np.ndarray]) -> tuple:
        size, digest, sums, tail = max(64, -(-n // 64) * 64), hashlib.sha256(), np.zeros(4, np.int64), b""
        left = size
        for pixels in shown:
            payload = payload_from(pixels, left)
            left -= len(payload)
            digest.update(payload)
            sums += payload.reshape(-1, 4).sum(axis=0, dtype=np.int64)
            tail = payload[-64:].tobytes()
        if left:
            raise ValueError("pictures that hold less than their payload")
        feature = f"{shown[0].shape[1]}x{sum(x.shape[0] for x in shown)} " + " ".join(f"{4 * m / size:.3f}" for m in sums.tolist())
        return size, digest.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = utf8(batch.column(2))
            for lo, hi in portions(np.diff(at)):
                out, sizes, files = [], batch.column(1)[lo:hi], batch.column(2)[lo:hi].to_pylist()
                parts = [files_of(file) for file in files]
                shown = iter(decode_all([x for part in parts for x in part]))
                for n, file, part in zip(sizes.to_pylist(), files, parts):
                    out.append(features(n, file, [next(shown) for _ in part]))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], sizes, *columns], names)

    return media.mapInArrow(run, OUT)
