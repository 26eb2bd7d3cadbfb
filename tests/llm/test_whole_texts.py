"""Operators against plain versions where nothing may be cut off: high rates, last bytes, learning from any place of a text."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposure.llm import bytecnn, langid, mixing
from exposure.llm.blocks import stretch


def plain_poisson(u, rate):
    k = max(0, math.floor(rate - 40 * math.sqrt(rate)))
    total = 0.0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if u < total:
            return k
        k += 1


@pytest.mark.parametrize("rate", [0.001, 0.7, 3.0, 250.0, 290.0, 2e4, 1e6])
def test_poisson_is_the_plain_one(spark, rate):
    rng = random.Random(int(rate * 1000))
    draws = [(rng.random(),) for _ in range(20)]
    rows = spark.createDataFrame(draws, "u double").select("u", mixing.poisson_count(F.col("u"), F.lit(rate)).alias("k")).collect()
    for r in rows:
        assert abs(r["k"] - plain_poisson(r["u"], rate)) <= (rate > 1e4)


@pytest.mark.parametrize("rate", [5e7, 4e8, 3e9])
def test_extreme_rates(spark, rate):
    """Quantiles of the normal distribution hold, less its skewness of a sixth of a copy."""
    rows = spark.createDataFrame([(0.0228,), (0.5,), (0.9772,)], "u double").coalesce(1)
    k = [r["k"] for r in rows.select("u", mixing.poisson_count(F.col("u"), F.lit(rate)).alias("k")).orderBy("u").collect()]
    for got, sigma in zip(k, (-2, 0, 2)):
        assert abs(got - rate - sigma * math.sqrt(rate)) < 2 + 0.002 * math.sqrt(rate)


def test_a_row_of_many_copies_is_dealt_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x", "en", "a", 1), (2, "y" * 400, "en", "b", 400), (3, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    whole = [tuple(r) for r in mixing.replicate(docs, {"a": 1.0, "b": 1.0}).collect()]
    monkeypatch.setattr(mixing, "COPIES", 16)
    mixed = mixing.replicate(docs, {"a": 1.0, "b": 1.0})
    assert [tuple(r) for r in mixed.collect()] == whole and mixed.schema["copy"].dataType.simpleString() == "int"
    count = collections.Counter(r[0] for r in whole)
    assert sorted(r[-1] for r in whole if r[0] == 1) == list(range(count[1])) and count[1] > 100


def plain_pooled(data, model):
    """A direct convolution: window by window, chunk by chunk."""
    n = max(len(data), bytecnn.WIDTH)
    padded = bytes(data) + bytes(n + 3 - len(data))
    s = []
    for i in range(n):
        again = i < len(data) and any(i >= lag and padded[i : i + 4] == padded[i - lag : i - lag + 4] for lag in range(1, bytecnn.LAGS + 1))
        s.append(padded[i] + 256 * again)
    places = sorted({*range(0, n - bytecnn.WIDTH + 1, bytecnn.STRIDE), n - bytecnn.WIDTH})
    out = [sum(model["filters"][j][s[p + j]].astype(float) for j in range(bytecnn.WIDTH)) for p in places]
    step = bytecnn.HALF // bytecnn.STRIDE
    halves = [np.max(out[k : k + step], axis=0) for k in range(0, len(out), step)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    on = np.maximum(np.array(chunks) + model["offset"], 0)
    return np.concatenate([on.mean(axis=0), on.max(axis=0)])


def test_convolution_is_the_direct_one(monkeypatch):
    rng = np.random.default_rng(4)
    model = bytecnn.fit([b"good text here " * 9, b"bad!! bad!! bad!!" * 9], [1, 0])
    model["filters"] += rng.normal(0, 1, model["filters"].shape).astype(np.float32)
    for piece in (512, 1 << 16):
        monkeypatch.setattr(bytecnn, "PIECE", piece)
        for n in (0, 1, 7, 8, 9, 10, 11, 255, 264, 265, 511, 512, 513, *range(514, 523), 1031, 1536, 2000):
            data = rng.integers(97, 100, n).astype(np.uint8)
            assert np.allclose(bytecnn.pooled(data, model), plain_pooled(data, model), atol=1e-4), (piece, n)


def test_the_last_byte_counts():
    rng = np.random.default_rng(5)
    model = bytecnn.fit([b"good text here " * 9, b"bad!! bad!! bad!!" * 9], [1, 0])
    model["filters"] += rng.normal(0, 3, model["filters"].shape).astype(np.float32)
    one, other = (np.frombuffer(t, np.uint8) for t in (b"elevenbytea", b"elevenbyteb"))
    assert not np.array_equal(bytecnn.pooled(one, model), bytecnn.pooled(other, model))


def test_a_stretch_lies_anywhere(spark):
    texts = [f"{i:03d}" + "abcdefghij" * 20 for i in range(200)] + ["short", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", stretch(F.col("text"), 50).alias("part")).collect()
    for r in rows:
        assert r["part"] == r["text"] if len(r["text"] or "") <= 50 else len(r["part"]) == 50 and r["part"] in r["text"]
    starts = {r["text"].index(r["part"]) for r in rows[:200]}
    assert len(starts) >= 9 and sum(r["part"] == r["text"][:50] for r in rows[:200]) < 20 and any(r["text"].endswith(r["part"]) for r in rows[:200])


def test_language_is_that_of_the_smallest_encoding(spark):
    """By a second route: a compressor built anew for each text and language from the same contents."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = langid.dictionaries(docs, langid.remainder(3) != 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.identify(docs).collect():
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        while "  " in plain:
            plain = plain.replace("  ", " ")
        sizes = []
        for _, content in known:
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(len(coder.compress(plain.encode())))
        assert r["lang_pred"] == known[sizes.index(min(sizes))][0]
        assert r["score"] == pytest.approx(1 / sum(2.0 ** (-8 * min(x - min(sizes), 100)) for x in sizes))


def test_equal_dictionaries_go_by_order(spark):
    docs = spark.createDataFrame([(1, "some text of words"), (2, "")], "doc_id long, text string")
    content = b"some words of text and more words"
    rows = langid.predict(docs, [("xx", content), ("aa", content)], F.lit(False)).orderBy("doc_id").collect()
    assert rows[0]["lang_pred"] == "xx" and rows[0]["rejected"] and rows[1]["lang_pred"] == "und"
