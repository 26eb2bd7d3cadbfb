"""What the encoder of operator 4 makes use of, payloads of several pictures, and pictures that are read in step."""

import hashlib
import os
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from exposure.llm import webp  # noqa: E402

SF = "/root/testdata/sf0.001"


def payload(text: bytes) -> np.ndarray:
    return webp.payload_of(np.frombuffer(text, np.uint8))


def kind_of(file: bytes) -> int | None:
    """The first transform of a file."""
    bits = webp.Bits(file[21:])
    bits.at = 32
    return bits.read(2) if bits.read(1) else None


def literals_alone(p: np.ndarray) -> float:
    """Bytes that the payload takes at least as literals under one code, without any head."""
    c = np.bincount(p, minlength=256)
    c = c[c > 0]
    return float((c * -np.log2(c / c.sum())).sum()) / 8


def steps(n: int) -> np.ndarray:
    """Pixels that change a little from one to the next."""
    walk = np.cumsum(np.random.default_rng(3).integers(-1, 2, (n, 4)), axis=0) + 128
    return (walk % 256).astype(np.uint8).ravel()


def grey(n: int) -> np.ndarray:
    """Red and blue nearly as green."""
    r = np.random.default_rng(4)
    g = r.integers(0, 256, n)
    return np.stack([np.full(n, 255), g + r.integers(0, 2, n), g, g], axis=1).astype(np.uint8).ravel()


def halved(n: int) -> np.ndarray:
    """Red and blue about half of green, all as signed numbers."""
    r = np.random.default_rng(5)
    g = r.integers(-128, 128, n)
    return np.stack([np.full(n, 255), (g >> 1) + r.integers(0, 2, n), g, g >> 1], axis=1).astype(np.int8).view(np.uint8).ravel()


CASES = {
    "predictor": (0, steps(4000)),
    "cross-colour": (1, halved(4000)),
    "subtract green": (2, grey(4000)),
    "palette": (3, np.random.default_rng(6).choice(np.frombuffer(b"north seawest lake", np.uint8)[:16].reshape(4, 4), 4000).ravel()),
}


@pytest.mark.parametrize("name", CASES)
def test_transforms(name):
    kind, p = CASES[name]
    file = webp.encode(p)
    assert kind_of(file) == kind
    assert (webp.payload_from(webp.decode(file), len(p)) == p).all()
    assert len(file) < literals_alone(p)


def test_back_references_and_cache():
    r = np.random.default_rng(7)
    words = r.integers(97, 123, (400, 4), dtype=np.uint8)
    text = words[r.integers(0, 400, 3000)].tobytes()
    p = payload(text + text[:4000])
    file = webp.encode(p)
    look, _ = webp.begin(file)
    assert look.cache_bits and (look.codes[0].symbol >= 256).any()
    # Each word is a pixel: about nine bits instead of nineteen, and the copy next to nothing.
    assert len(file) < 0.75 * literals_alone(p)
    assert (webp.payload_from(webp.decode(file), len(p)) == p).all()


def test_rows_of_the_table_use_them():
    texts = [x or "" for x in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    payloads = [payload(x.encode()) for x in texts]
    media = list(webp.pictures(payloads))
    looks = [webp.begin(x)[0] for x in media]
    assert np.mean([x.cache_bits > 0 for x in looks]) > 0.9
    assert np.mean([(x.codes[0].symbol >= 256).any() for x in looks]) > 0.9
    heads = 0.0
    for p in payloads:
        once = webp.Writer()
        once.put_code(webp.code_lengths(np.bincount(p, minlength=256), 15))
        heads += 4 * once.size / 8
    # Literals under one code, which is written four times, took more.
    assert sum(map(len, media)) < heads + sum(map(literals_alone, payloads))
    for x, p in zip(webp.decode_all(media), payloads):
        assert (webp.payload_from(x, len(p)) == p).all()


def test_together_as_alone():
    r = np.random.default_rng(8)
    payloads = [payload(r.choice(np.frombuffer(b"some letters, 12345", np.uint8), n).tobytes()) for n in r.integers(0, 6000, 150)]
    payloads += [p for _, p in CASES.values()] + [payload(b""), payload(b"a" * 5000)]
    media = list(webp.pictures(payloads))
    assert media == [webp.encode(p) for p in payloads]
    for x, y in zip(webp.decode_all(media), map(webp.decode, media)):
        assert x.shape == y.shape and (x == y).all()


def test_broken_among_others():
    media = list(webp.pictures([payload(b"some text %d " % k * 30) for k in range(80)]))
    for bad in (media[40][:60], media[40][:-20]):
        with pytest.raises(ValueError):
            webp.decode_all([*media[:40], bad, *media[41:]])


def test_long_codes_and_distances():
    # Counts like Fibonacci numbers ask for codes of over 12 bits; the copy comes from far away.
    counts = [1, 1]
    while len(counts) < 22:
        counts.append(counts[-1] + counts[-2])
    rare = np.random.default_rng(9).permutation(np.repeat(np.arange(22, dtype=np.uint8), counts))
    p = payload(np.concatenate([rare, np.random.default_rng(10).integers(0, 256, 400_000, dtype=np.uint8), rare]).tobytes())
    assert (webp.payload_from(webp.decode(webp.encode(p)), len(p)) == p).all()


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    yield session


def test_text_of_several_pictures(spark):
    text = "".join(f"{k} small things, " for k in range(160_000))
    assert len(text) > 2.5 * webp.PART
    media = webp.stored(spark.createDataFrame([(1, text), (2, None), (3, text[:100])], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in media.collect()}
    assert len(webp.files_of(bytes(rows[1]["media"]))) == -(-len(text) // webp.PART)
    out = {r["doc_id"]: r for r in webp.read_back(media).collect()}
    p = text.encode() + bytes(-len(text) % 64)
    r = out[1]
    assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(p), zlib.crc32(p[-64:]))
    assert r["payload_sha256"] == hashlib.sha256(p).hexdigest()
    assert (r["media_bytes"], r["media_sha256"]) == (len(rows[1]["media"]), hashlib.sha256(bytes(rows[1]["media"])).hexdigest())
    means = np.frombuffer(p, np.uint8).reshape(-1, 4).mean(axis=0)
    assert r["feature"] == f"16x{len(p) // 64} " + " ".join(f"{m:.3f}" for m in means)
    assert out[2]["payload_bytes"] == 64 and out[3]["n_bytes"] == 100


def test_memory_does_not_grow_with_a_text(monkeypatch):
    monkeypatch.setattr(webp, "PART", 1 << 16)

    def peak(n: int) -> int:
        p = payload(b"a line that comes again and again, and a number\n" * (n // 48))
        tracemalloc.start()
        [media] = webp.pictures([p])
        for file in webp.files_of(media):
            webp.decode(file)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    # Before, both directions held eight bytes and more for each of the text.
    assert peak(1 << 20) < peak(1 << 18) + (3 << 18)


def test_batches_are_bounded(monkeypatch):
    sizes = np.array([5, 5, 5, 30, 1, 1])
    monkeypatch.setattr(webp, "BATCH", 10)
    assert list(webp.portions(sizes)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(webp.portions(sizes[:0])) == []
