"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import os
import sys

import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from exposure.llm import balltree, bytecnn, bytepairs, hyperminhash, langid, lines, manifest, mixing, packing, pii, pitmanyor, suffixes, webp  # noqa: E402

TOKENS = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, None, None, None, None),
    (None, "no id here", "en", "s", 10),
    (2, "", "en", "s", 0),
    (3, LONG, "en", "s", len(LONG)),
    (4, "same text twice, mail a@b.com\nand a line", "en", "s", 40),
    (4, "same text twice, mail a@b.com\nand a line", "en", "s", 40),
    (5, " \t\n\x0b\x0c\r ", "en", None, 7),
    (6, "é" * 300 + " naïve 12345 \x00 nul", "fr", "s", 310),
    (7, "x" * 5000, "fr", "t", 5000),
]
LABELS = [(2, 1, 0), (3, 0, 0), (4, 1, None), (4, None, 1), (None, 1, 1)]

OPERATORS = {
    "lines": lambda d, k: lines.line_quality(d),
    "clean": lambda d, k: lines.clean_documents(d),
    "pitmanyor": lambda d, k: pitmanyor.score_texts(d),
    "pii": lambda d, k: pii.tag(d, pii.learned(d)),
    "mask": lambda d, k: pii.mask(d),
    "webp": lambda d, k: webp.read_back(webp.stored(d)),
    "packing": lambda d, k: packing.pack(d, TOKENS),
    "near": lambda d, k: hyperminhash.near_duplicates(d),
    "one_of_each": lambda d, k: hyperminhash.one_of_each(d),
    "langid": lambda d, k: langid.identify(d),
    "suffixes": lambda d, k: suffixes.remove_repeats(d),
    "mixing": lambda d, k: mixing.replicate(d),
    "bytecnn": lambda d, k: bytecnn.quality(d, k),
    "balltree": lambda d, k: balltree.ranked(d, d.sparkSession.createDataFrame([(1, "same word é")], "item_id long, text string")),
    "bytepairs": lambda d, k: bytepairs.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "manifest": lambda d, k: manifest.manifest(d),
}
EACH_ROW = ("lines", "pitmanyor", "pii", "mask", "webp", "near", "langid", "suffixes", "bytecnn", "bytepairs")
CLASHING = ("_row", "_all", "row", "label", "copy", "n_words", "kept", "_line", "fingerprint", "bucket", "_key", "packed", "score", "held_out", "rank", "size", "node", "block", "terms", "_tie", "leaf", "root")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, labels, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING:
        from pyspark.sql import functions as F

        docs = docs.withColumn(c, F.lit("clash"))
    out = OPERATORS[name](docs, labels)
    rows = [r.asDict() for r in out.collect()]
    if name in EACH_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
        same = [tuple(v for k, v in r.items()) for r in rows if r["doc_id"] == 4]
        assert len(same) == 2 and same[0] == same[1]
    if name in ("clean", "one_of_each", "mask"):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(r["label"] == "clash" for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, labels, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](docs, labels.limit(0)).collect() == []


def test_values_of_odd_rows(spark, labels):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    by = {name: {r["doc_id"]: r for r in OPERATORS[name](docs, labels).collect()} for name in ("lines", "langid", "suffixes", "near", "webp", "pii", "packing")}
    assert by["lines"][1]["n_words"] == 0 and by["lines"][1]["base_failed"]
    assert by["lines"][3]["n_repeat_words"] == 60_000
    assert by["langid"][1]["lang_pred"] == "und" and by["langid"][5]["lang_pred"] == "und"
    assert by["suffixes"][3]["n_removed"] == len(LONG) and by["suffixes"][3]["n_spans"] == 1
    assert by["suffixes"][7]["n_removed"] == 5000 and by["suffixes"][4]["n_removed"] == 0
    assert by["near"][1]["component_id"] == 1 and by["near"][2]["n_shingles"] == 0 and by["near"][3]["n_shingles"] == 1
    assert by["webp"][1]["payload_bytes"] == 64 and by["webp"][1]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()
    assert by["pii"][4]["n_email"] == 1 and by["pii"][4]["spans"] == "email:22:29"
    assert by["packing"][1]["doc_tokens"] == 1


def test_one_of_each_takes_repeats_once(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(str(r["doc_id"]) for r in hyperminhash.one_of_each(docs).collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]
