"""The stages of the pipeline against plain versions, each on what the one before kept."""

import collections
import hashlib
import os
import sys

import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from exposure.llm import lines, pii  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into and comes out of each stage, as rows."""
    out, docs = [], spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns or k == 4
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_rules(stages):
    before, after = stages["quality rules"]
    assert texts(after) == brute.cleaned(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_lines_are_removed(spark):
    """A line that 15 of 20 texts of a host share goes from all but the first; a document of such lines alone is rejected."""
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(20)]
    shared = " ".join(f"common{k}" for k in range(55))
    rows = [{"doc_id": i, "text": f"{own[i]}\n {shared.upper()}  " if i < 15 else own[i], "lang": "en", "source": "h", "n_chars": 0} for i in range(20)]
    rows += [{"doc_id": 90, "text": shared, "lang": "en", "source": "h", "n_chars": 0}, {"doc_id": 91, "text": shared, "lang": "en", "source": "other", "n_chars": 0}]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = texts([r.asDict() for r in lines.clean_documents(docs).collect()])
    assert kept == brute.cleaned(rows)
    assert 90 not in kept and 91 in kept and kept[0] == rows[0]["text"] and kept[1] == own[1]


def test_near_duplicates(stages):
    before, after = stages["near duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before]
    assert sorted(texts(after)) == sorted({c for c in brute.near_components(rows, 80, 5)})


def test_personal_data(spark, stages):
    before, after = stages["personal data"]
    model = pii.learned(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string"))
    assert texts(after) == {d: pii.masked(t, sum(pii.find(t, model), [])) for d, t in texts(before).items()}
    assert all(not pii.base_spans(t) for t in texts(after).values())


def test_source_mix(stages):
    before, after = stages["source mix"]
    chars = collections.Counter()
    for r in before:
        chars[r["source"]] += len(r["text"])
    wanted = collections.Counter()
    for r in before:
        u = int(hashlib.md5(f"42|{r['doc_id']}|{r['text']}".encode()).hexdigest()[:12], 16) / 2**48
        if n := brute.poisson(u, sum(chars.values()) / len(chars) / chars[r["source"]]):
            wanted[r["doc_id"]] = n
    assert collections.Counter(r["doc_id"] for r in after) == wanted


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r["length"] for r in after) == tokens
    assert collections.Counter(r["doc_id"] for r in after if r["start"] == 0) == collections.Counter(r["doc_id"] for r in before)


def test_lines_of_a_large_host(spark):
    """A line in 20 of 3,000 texts of a host goes as it would on a small one."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, own(i) + ("\nall rights reserved" if i < 20 else ""), "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert len(out) == 3000 and [d for d in sorted(out) if "rights" in out[d]] == [0]
