"""Pictures written here with every feature of the format, read back."""

import numpy as np
import pytest

from exposure.llm import webp

RNG = np.random.default_rng(4)


def put_image(out: webp.Writer, pixels: np.ndarray, main: bool, cache: int = 0, back: bool = False, groups: np.ndarray | None = None, block: int = 2) -> None:
    """Codes pixels (height, width) with literals, and on request colour cache, back-references and several groups."""
    height, width = pixels.shape
    flat = pixels.ravel().tolist()
    out.put(int(cache > 0), 1)
    if cache:
        out.put(cache, 4)
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            out.put(block - 2, 3)
            put_image(out, (groups.astype(np.uint32) << np.uint32(8)), False)
    tokens, seen, at = [], {}, 0
    while at < len(flat):
        g = int(groups[at // width >> block, at % width >> block]) if groups is not None else 0
        run = 0
        while back and at and at + run < len(flat) and flat[at + run] == flat[at + run - 1] and run < 4:
            run += 1
        slot = (webp.CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache) if cache else None
        if run >= 2:
            new = flat[at : at + run]
            # A length of run, and distance 1: code 2, the pixel to the left.
            tokens.append((g, (256 + run - 1, 1)))
        elif cache and seen.get(slot, 0) == flat[at]:
            new = flat[at : at + 1]
            tokens.append((g, (280 + slot,)))
        else:
            new = flat[at : at + 1]
            p = flat[at]
            tokens.append((g, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)))
        for p in new:
            if cache:
                seen[(webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache)] = p
        at += len(new)
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    codes = []
    for g in range(int(groups.max()) + 1 if groups is not None else 1):
        mine = [t for k, t in tokens if k == g]
        counts = [np.zeros(n, np.int64) for n in sizes]
        for t in mine:
            counts[0][t[0]] += 1
            for k, s in enumerate(t[1:]):
                counts[4 if len(t) == 2 else k + 1][s] += 1
        lengths = [webp.code_lengths(c, 15) for c in counts]
        for x in lengths:
            out.put_code(x)
        codes.append([(x, webp.canonical(x.tolist()) if (x > 0).sum() > 1 else None) for x in lengths])
    for g, t in tokens:
        for k, s in enumerate(t):
            length, code = codes[g][4 if len(t) == 2 and k else k]
            if code is not None:
                out.put(code[s], int(length[s]))


def picture(width, height, coded, transforms=(), **kind) -> bytes:
    out = webp.Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    for put in transforms:
        out.put(1, 1)
        put(out)
    out.put(0, 1)
    put_image(out, coded, True, **kind)
    return webp.wrap(out.bytes())


def noise(height, width, colours=None) -> np.ndarray:
    p = RNG.integers(0, 1 << 32, (height, width), dtype=np.uint32)
    return p if colours is None else RNG.integers(0, 1 << 32, colours, dtype=np.uint32)[p % colours]


@pytest.mark.parametrize("kind", [{}, {"cache": 3}, {"back": True}, {"cache": 2, "back": True}, {"groups": True}, {"groups": True, "back": True, "cache": 5}])
def test_symbols(kind):
    pixels = np.repeat(noise(19, 9, 6), 3, axis=1)
    if "groups" in kind:
        kind = kind | {"groups": RNG.integers(0, 3, (5, 7))}
        kind["groups"][0, 0] = 2
    assert (webp.decode(picture(27, 19, pixels, **kind)) == pixels).all()


def test_windows_of_bits(monkeypatch):
    pixels = np.repeat(noise(40, 30, 50), 2, axis=1)
    monkeypatch.setattr(webp, "WINDOW", 512)
    for kind in ({}, {"back": True}):
        assert (webp.decode(picture(60, 40, pixels, **kind)) == pixels).all()


def test_subtract_green():
    pixels = noise(5, 6)
    c = webp.split(pixels)
    c[..., 1] -= c[..., 2]
    c[..., 3] -= c[..., 2]
    assert (webp.decode(picture(6, 5, webp.join(c), [lambda out: out.put(2, 2)])) == pixels).all()


def test_cross_colour():
    pixels, elements = noise(9, 10), noise(3, 3)
    c, e = webp.split(pixels), webp.split(elements)
    rest = c.copy()
    for y in range(9):
        for x in range(10):
            _, to_blue, green_blue, green_red = (int(v) for v in e[y >> 2, x >> 2])
            signed = lambda v: v - 256 if v > 127 else v
            red, green = int(c[y, x, 1]), int(c[y, x, 2])
            rest[y, x, 1] = red - (signed(green_red) * signed(green) >> 5)
            rest[y, x, 3] = c[y, x, 3] - (signed(green_blue) * signed(green) >> 5) - (signed(to_blue) * signed(red) >> 5)

    def put(out):
        out.put(1, 2)
        out.put(0, 3)
        put_image(out, elements, False)

    assert (webp.decode(picture(10, 9, webp.join(rest), [put])) == pixels).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 7, 6
    pixels = noise(height, width)
    c = webp.split(pixels).reshape(-1, 4)
    rest = c.copy()
    average = lambda a, b: (a + b) // 2
    for i in range(len(c)):
        y, x = divmod(i, width)
        if not y or not x:
            guess = c[i - 1] if x else c[i - width] if y else np.array([255, 0, 0, 0])
        else:
            left, top, corner, right = c[i - 1], c[i - width], c[i - width - 1], c[i - width + 1]
            whole = left + top - corner
            half = average(left, top)
            guess = [
                np.array([255, 0, 0, 0]), left, top, right, corner, average(average(left, right), top), average(left, corner), average(left, top),
                average(corner, top), average(top, right), average(average(left, corner), average(top, right)),
                left if abs(whole - left).sum() < abs(whole - top).sum() else top, np.clip(whole, 0, 255),
                np.clip(half + ((half - corner) / 2).astype(int), 0, 255),
            ][mode]
        rest[i] = c[i] - guess

    def put(out):
        out.put(0, 2)
        out.put(1, 3)
        put_image(out, np.full((1, 1), mode << 8, np.uint32), False)

    assert (webp.decode(picture(width, height, webp.join(rest).reshape(height, width), [put])) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 13, 16, 40])
def test_palette(colours):
    width, height = 11, 4
    palette = RNG.integers(0, 1 << 32, colours, dtype=np.uint32)
    index = RNG.integers(0, colours, (height, width))
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, each = 1 << packed, 8 >> packed
    narrow = -(-width // per)
    coded = np.zeros((height, narrow), np.uint32)
    for x in range(width):
        coded[:, x // per] |= (index[:, x] << (each * (x % per)) << 8).astype(np.uint32)

    def put(out):
        out.put(3, 2)
        out.put(colours - 1, 8)
        c = webp.split(palette)
        put_image(out, webp.join(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int32)))[None], False)

    assert (webp.decode(picture(width, height, coded, [put])) == palette[index]).all()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 300_000])
@pytest.mark.parametrize("spread", [1, 3, 256])
def test_payload_round_trip(n, spread):
    payload = webp.payload_of(RNG.integers(0, spread, n, dtype=np.uint8))
    file = webp.encode(payload)
    assert (webp.payload_from(webp.decode(file), len(payload)) == payload).all()
    assert len(file) < len(payload) + 900


def test_broken_files():
    file = webp.encode(webp.payload_of(np.frombuffer(b"some text " * 50, np.uint8)))
    for bad in (b"", file[:30], file[:-20], b"RIFX" + file[4:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
