"""Operators against plain versions, exact round trips and held-out results."""

import collections
import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from exposure.llm import bytecnn, hyperminhash, langid, mixing, packing, pii, pitmanyor, suffixes  # noqa: E402

TOKENS = public_tokenizers.path("word_bpe_49k.json")
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 40, 120]))
        for _ in range(rng.choice([1, 2, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_near_components(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rows = near_rows()
    found = {r["doc_id"]: r for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[d]["component_id"] for d, _ in rows] == brute.near_components(rows)
    assert all(found[d]["n_shingles"] == len(brute.shingles(t)) for d, t in rows)


def test_register_estimate():
    rng = np.random.default_rng(1)
    by = hyperminhash.multipliers()
    a = rng.integers(1, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate([a[:900], rng.integers(1, 1 << 63, 100, dtype=np.uint64)])
    equal = (hyperminhash.registers(a, by) == hyperminhash.registers(b, by)).sum()
    assert abs(hyperminhash.estimate(np.array([equal]), np.array([1000]), np.array([1000]))[0] - 900 / 1100) < 0.15
    one = hyperminhash.registers(np.array([1 << 40], np.uint64), np.ones(hyperminhash.REGISTERS, np.uint64))
    assert set(one.tolist()) == {23 << 10}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_bytes(spark, docs, texts, hot):
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(docs, hot).collect()}
    for (d, _), (gone, runs, kept) in zip(texts.items(), brute.repeated_bytes(list(texts.values()))):
        r = found[d]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (gone, runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("behind", [10, 90])
def test_repeats_behind_a_span(spark, behind):
    """A passage that begins right behind a multiple of SPAN of a long text goes whole."""
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage, at = draw(250), suffixes.SPAN + behind
    rows = [(1, draw(at) + "#" + passage + "+" + draw(3000)), (2, draw(500) + "-" + passage + "=" + draw(500))]
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in found} == {1: (250, 1), 2: (250, 1)}


def test_blind_trie():
    rng = random.Random(1)
    for _ in range(300):
        x = [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randint(1, 12))]
        order, shared = suffixes.blind_trie(x)
        assert [x[i] for i in order] == sorted(x)
        for k in range(1, len(x)):
            a, b = x[order[k - 1]], x[order[k]]
            assert shared[k] == next((i for i in range(8) if a[i] != b[i]), 8)


def test_language_model(docs, texts):
    found = {r["doc_id"]: r for r in pitmanyor.score_texts(docs).collect()}
    count = collections.Counter()
    tokens = {d: brute.words(brute.ascii_lower(t or "")) + [" end"] for d, t in texts.items()}
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(w)
    n, v, base, score = sum(count.values()), len(count), 0.0, 0.0
    for d, w in tokens.items():
        r = found[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > 0.9 * base


def test_model_adds_up():
    """Known words, the end and the event of any other word have all the probability; spellings of up to 3 letters nearly all."""
    words = [b"a", b"ab", b"b", b"aba"]
    text = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    keys, counts = np.unique(np.append(pitmanyor.byte_keys(text)[0], pitmanyor.EMPTY_WORD), return_counts=True)
    spelling = pitmanyor.Spelling(keys, counts)
    k, word = pitmanyor.byte_keys(text)
    spelled = np.column_stack([spelling.of(k, word, 4), spelling.of(np.array([pitmanyor.EMPTY_WORD]), np.array([0]), 1)])
    assert (spelled.sum(axis=1) < 1).all()
    count = np.array([500, 3, 1, 40, 7])
    tables = pitmanyor.word_tables(count, spelled, 0.5, 1.0, 5, 0)
    assert ((tables >= 1) & (tables <= count)).all()
    known = pitmanyor.predictive(count, tables, spelled, tables.sum(axis=1), count.sum(), 0.5, 1.0).sum()
    other = pitmanyor.predictive(0, np.zeros((len(tables), 1)), 1 - spelled.sum(axis=1, keepdims=True), tables.sum(axis=1), count.sum(), 0.5, 1.0)
    assert known + other[0] == pytest.approx(1)
    for context in (0, pitmanyor.END, 97 * 257 + 98, pitmanyor.END * 257 + 97):
        all_next = spelling.of(context * 257 + np.arange(257), np.arange(257), 257)
        assert all_next.sum(axis=1) == pytest.approx(1)


def test_words_have_contexts(spark, monkeypatch):
    """The order of words counts; contexts in parts score the same texts alike, and better than words alone."""
    rng = random.Random(5)
    follows = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(3)] for i in range(60)}
    rows = []
    for d in range(400):
        w = ["w0"]
        while len(w) < 40:
            w.append(rng.choice(follows[w[-1]]))
        rows.append((d, " ".join(w)))
    held = [d for d in range(400, 500) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    rows += [(held[0], rows[0][1]), (held[1], " ".join(reversed(rows[0][1].split())))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for least, bucket_rows in ((20_000, 4000), (200, 100)):
        monkeypatch.setattr(pitmanyor, "LEAST", least)
        found.append({r["doc_id"]: r for r in pitmanyor.score_texts(docs, bucket_rows=bucket_rows).collect()})
    for by in found:
        assert by[held[0]]["score"] > by[held[1]]["score"] + 10
        assert by[held[0]]["score"] > 0.7 * by[held[0]]["base_score"]
        assert by[held[0]]["base_score"] == pytest.approx(by[held[1]]["base_score"])
    assert found[0][held[0]]["score"] == pytest.approx(found[1][held[0]]["score"], rel=0.05)


def test_context_adds_up():
    """Behind each word the known words, the end and any other word have all the probability."""
    count, ends = np.array([9, 4, 2, 0]), 5
    size = np.array([2] * 16 + [1] * 4 + [0])
    token = np.concatenate([np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)]).reshape(2, 16).T.ravel()
    token = np.append(token, np.arange(4))
    local = np.bincount(token)
    rank = np.argsort(np.argsort(-local, kind="stable"))
    mine = {"held": np.ones(21, bool), "size": size, "token": pitmanyor.thin(rank[token]), "local": pitmanyor.thin(local), "bounds": np.array([0, 4])}
    assert pitmanyor.tokens_in(mine).tolist() == token.tolist()
    pairs = pitmanyor.Pairs(mine, count, np.array([1, 2, 3, 0]), ends, 1, 1 << 40)
    u, w = pairs.u[pairs.asked], pairs.w[pairs.asked]
    n = np.zeros(len(u), np.int64)
    for c in (0, 1, 2, 4):
        at = np.flatnonzero(u == c)
        n[at] = np.random.default_rng(c).multinomial(pairs.count[c], np.full(len(at), 1 / len(at)))
    cut, context = 0.4, np.cumsum(np.diff(u, prepend=u[0]) != 0)
    tables = pitmanyor.context_tables(context, n, np.full(len(u), 0.2), np.ones(len(u), int), cut, 1.0, 0)
    assert ((tables >= np.minimum(n, 1)) & (tables <= n)).all() and len(tables) == pitmanyor.SAMPLES
    total = tables.sum(axis=0)
    reply = pitmanyor.squeeze(count=pitmanyor.thin(n), tables=pitmanyor.thin(total[n > 1]), seated=pitmanyor.thin(np.bincount(context, total)), cut=cut)
    plain = np.log10([0.4, 0.2, 0.1, 0.05, 0.25])
    p = 10 ** pitmanyor.in_context(pairs, [0], [reply], {}, plain, 1.0, 1 << 40)
    assert len(p) == 25 and np.bincount(pairs.u, p) == pytest.approx(1)


def test_tables_of_a_pair_follow_their_distribution():
    log_s = pitmanyor.stirling(4, 0.3)
    assert np.exp(log_s[3, 1:4]) == pytest.approx([0.7 * 1.7, 0.7 + 1.4, 1])
    n = 40_000
    drawn = pitmanyor.context_tables(np.arange(n), np.full(n, 2), np.full(n, 0.5), np.ones(n, int), 0.3, 1.0, 0)
    assert (drawn[-1] == 2).mean() == pytest.approx(0.5 / (0.5 + 0.7), abs=0.02)


def test_tables_of_words_are_customers_of_the_spelling(spark):
    text = np.frombuffer(b"ab b ", np.uint8)
    end = pitmanyor.END
    assert [divmod(k // 257, 257) + (k % 257,) for k in pitmanyor.byte_keys(text)[0].tolist()][3:] == [(end, end, 98), (end, 98, end)]
    packed = [pitmanyor.squeeze(text=text, tables=np.array([[1, 1], [5, 2]]))]
    rows = pitmanyor.spelling_counts(spark.createDataFrame([(bytearray(p),) for p in packed], "packed binary")).collect()
    keys, word = pitmanyor.byte_keys(text)
    assert {r["key"]: r["n"] for r in rows} == dict(zip(keys.tolist(), np.array([5, 2])[word].tolist()))


def test_seats_keep_their_customers():
    seats = pitmanyor.Seats(np.array([1, 2, 17, 400, 30_000]), np.random.default_rng(0))
    new = np.full(5, 0.7)
    seats.fill(new, 0.5)
    for _ in range(50):
        seats.sweep(new, 0.5)
        at_tables = (seats.small * np.arange(pitmanyor.SIZES)).sum(axis=1) + seats.seated
        assert at_tables.tolist() == seats.customers.tolist()
        assert (seats.small >= 0).all() and (seats.seated >= pitmanyor.SIZES * seats.large).all()


def test_rules_and_field(texts):
    for t in [*texts.values(), "a@b@c.de x@y.z, q.@a.b-c.d @@ a@b 1.2.3.4.5 +1 (234) 567-8901 4111 1111 1111 1111"]:
        assert [(m.start(), m.end()) for m in pii.RULES[0].finditer(t)] == [(m.start(), m.end()) for m in pii.emails(t)]
    spans = pii.base_spans("ip 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111, phone +1 (234) 567-8901")
    assert pii.spell(spans) == "ip:18:27,card:34:53,phone:61:78"
    assert pii.masked("mail a@b.co now", [(0, 5, 11)]) == "mail <EMAIL> now"


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENS)
    odd = {-1: "<|ENDOFTEXT|> <|endoftext|> İstanbul ΑΣ don't 3.14, é a b ..,. it's,"}
    extra = docs.sparkSession.createDataFrame(list(odd.items()), "doc_id long, text string")
    rows = [r.asDict() for r in packing.pack(docs.select("doc_id", "text").union(extra), TOKENS).collect()]
    ids = {d: [*whole.encode(t, add_special_tokens=False).ids, 2] for d, t in (texts | odd).items()}
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[d])
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(pieces) == len(ids) and 4096 * (len(windows) - 1) < 1.02 * sum(map(len, ids.values()))


def test_least_slack_is_found():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 10))]
        chosen = packing.filling(collections.Counter(lengths), 50)
        best = max(sum(x for k, x in enumerate(lengths) if m >> k & 1) for m in range(1 << len(lengths)) if m and sum(x for k, x in enumerate(lengths) if m >> k & 1) <= 50 and max(x for k, x in enumerate(lengths) if m >> k & 1) == max(lengths))
        assert sum(k * n for k, n in chosen.items()) == best
        assert not collections.Counter(chosen) - collections.Counter(lengths)


def test_held_out_results(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in big.collect()}
    found = [r for r in langid.identify(big).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) > 0.95 * len(found)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = [r for r in bytecnn.quality(big, labels).collect() if r["held_out"] and r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in found) > 0.9 * len(found)


def test_network_covers_whole_texts(monkeypatch):
    model = bytecnn.fit([b"good text here " * 9, b"bad!! bad!! bad!!" * 9], [1, 0])
    data = np.frombuffer(b"good text here " * 900 + b"bad!!" * 3, np.uint8)
    whole = bytecnn.pooled(data, model)
    for size in (512, 1024, 4096):
        monkeypatch.setattr(bytecnn, "PIECE", size)
        assert np.allclose(bytecnn.pooled(data, model), whole, atol=1e-5)


def test_mixture(spark):
    rows = [(i, "x" * 20, "en", "big" if i % 5 else "small", 20) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    count = collections.Counter(r["source"] for r in mixing.replicate(docs, {"big": 1.0, "small": 3.0}).collect())
    assert abs(count["small"] / sum(count.values()) - 0.75) < 0.03
    from pyspark.sql import functions as F

    for rate, u, expected in ((2.0, 0.0, 0), (2.0, 0.5, 2), (2.0, 0.99, 6), (900.0, 0.5, 900)):
        assert spark.range(1).select(mixing.poisson_count(F.lit(u), F.lit(rate)).alias("k")).first()["k"] == expected


def test_multikey_quicksort():
    """The order is that of a plain sort by group and words, with many ties, sorted, reversed and empty input."""
    random = np.random.default_rng(11)
    for n, kinds, groups in ((0, 1, 1), (1, 1, 1), (500, 3, 4), (5000, 40, 7), (3000, 1 << 62, 1), (2000, 2, 900)):
        words = random.integers(0, kinds, (n, 3)).astype(np.uint64) << np.uint64(1)
        group = random.integers(0, groups, n)
        for w in (words, np.sort(words, axis=0), np.sort(words, axis=0)[::-1]):
            for depth in (1, 2, 3):
                order = suffixes.multikey_quicksort(group, w, depth)
                assert sorted(order.tolist()) == list(range(n))
                keys = [(int(group[r]), *w[r, :depth].tolist()) for r in order.tolist()]
                assert keys == sorted(keys)
