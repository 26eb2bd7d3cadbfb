"""Ranked search, token counts and the manifest against plain versions."""

import hashlib
import math
import os
import random
import re
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

from exposure.llm import balltree, bytepairs, manifest  # noqa: E402
from exposure.llm.oracles import OP11, OP13  # noqa: E402
from exposure.llm.queries import op11_ball_tree, op12_rank_merging, op13_struct_rollup  # noqa: E402

DIR = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def duck(**tables):
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(rows[0]))})", rows)
    return con


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=str)


# --- ranked search --------------------------------------------------------------------------------


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(docs, items, k=50):
    found = [(d, terms(t)) for d, t in docs]
    n, length = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    out = []
    for item, text in items:
        own, scores = set(terms(text)), []
        for d, ts in found:
            if not ts:
                continue
            m = 50 + 50 * len(ts) * n // length
            score = 0
            for t in own & set(ts):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in set(x) for _, x in found) + 1)))
                tf = ts.count(t)
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return by_value(out)


def odd_docs(n=150):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ſ", "K", "The", "the", "1a", "ñandú"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for i in range(n)]
    docs += [(None, "the w1 w2"), (None, None), (3, "w1 w1 w1"), (3, "w1 w1 w1"), (n, "w5 " * 20_000), (n + 1, "\x00-w1!w2_w3\n")]
    items = [(1, "The w1 w2, w3."), (2, None), (3, "absent"), (4, "É k K ſ w5"), (4, "w5"), (5, " ".join(words)), (6, "")]
    return docs, items


@pytest.mark.parametrize("sizes", [(64, 8192, 64, 256, 16_384), (2, 7, 2, 2, 20)])
def test_ranking_is_the_plain_one(spark, monkeypatch, sizes):
    for name, v in zip(("LEAF", "BLOCK", "SAMPLE", "GROUP_ITEMS", "GROUP_TERMS"), sizes):
        monkeypatch.setattr(balltree, name, v)
    docs, items = odd_docs()
    got = balltree.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert by_value(got.collect()) == plain_ranking(docs, items, 10)


def test_ranking_of_nothing(spark):
    docs, items = odd_docs(10)
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert balltree.ranked(none[0], some[1]).collect() == [] and balltree.ranked(some[0], none[1]).collect() == []
    blank = spark.createDataFrame([(1, " -- "), (2, None)], "doc_id long, text string")
    assert balltree.ranked(blank, some[1]).collect() == []


def test_many_equal_documents_keep_the_least_ids(spark):
    docs = [(i, "w1 w2 same") for i in range(500)] + [(1000 + i, f"w1 other{i}") for i in range(100)]
    got = balltree.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "w2")], "item_id long, text string"))
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == list(range(50))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    size, n = 80, 600
    rows = [np.unique(rng.integers(0, size // 2 if i % 2 else size, 12)).astype(np.int32) for i in range(n)]
    counts = [rng.integers(1, 50, len(r)).astype(np.int32) for r in rows]
    items = [np.unique(rng.integers(0, size, 6)).tolist() for _ in range(20)] + [[70, 71, 72]]
    held = np.bincount(np.concatenate(rows), minlength=size)
    queries = balltree.Queries(items, rng.integers(1, 9000, size), held)
    block = balltree.Block(list(range(n)), np.full(n, 400), [r.tobytes() for r in rows], [c.tobytes() for c in counts], n, 400 * n)
    tree = balltree.Tree(block, queries)
    exact = np.zeros((n, len(items)), np.int64)
    for d in range(n):
        of = slice(block.at[d], block.at[d + 1])
        exact[d] = (queries.weights[:, block.term[of]].astype(np.int64) * block.impact[of]).sum(axis=1)
    for node, docs in enumerate(tree.docs):
        assert (tree.bound[node] >= exact[docs].max(axis=0)).all()
    assert sorted(np.concatenate(tree.docs[tree.inner :]).tolist()) == list(range(n))
    for i in range(len(items)):
        best, opened = tree.search(i, queries.weights[i].astype(np.int64), 0, 5)
        assert sorted(best) == sorted((int(exact[d, i]), -d) for d in sorted(range(n), key=lambda d: (-exact[d, i], d))[:5])
        assert opened <= tree.inner + 1


def test_hash_hits_are_confirmed_by_bytes():
    vocabulary = balltree.Vocabulary([b"same", b"other"])
    data, at = balltree.utf8(balltree.pa.array(["same sAME diff other"]))
    (run,) = vocabulary.words.runs(data, at)
    run.hash[2] = run.hash[0]
    assert vocabulary.find(run)[0].tolist() == [0, 1, 3]


def test_op11_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert by_value(op11_ball_tree(spark, DIR).collect()) == by_value(con.execute(OP11).fetchall())


def test_op11_sql_equals_plain():
    docs, items = odd_docs(40)
    con = duck(documents=("doc_id BIGINT, text VARCHAR", docs), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert by_value(con.execute(OP11).fetchall()) == plain_ranking(docs, items)


# --- token counts ---------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(1)
    odd = [chr(x) for x in (0x558, 0x88F, 0x85, 0xA0, 0x1C, 0x1F, 0x2028, 0x3000, 0x4E00, 0x1F600, 0xC5C, 0x661, 0xBD)]
    parts = ["a", "b", " ", "  ", "\n", "é", "1", "23", "'s", "the ", "'ll", "!", "..", "<|endoftext|>", "<|endof", *odd]
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000, " " * 5000, "\n\n  a", "it's we'll I'D 'tis", "word " * 60_000]
    texts += ["".join(rng.choice([*parts, chr(rng.randrange(0x20, 0xD7FF))]) for _ in range(rng.choice([1, 5, 30, 300]))) for _ in range(400)]
    return texts + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "ab " * 3 + "c" * 2_000 + " \n d"]


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("window, remembered", [(1 << 20, 500_000), (50, 100)])
def test_counts_are_the_library_s(monkeypatch, window, remembered):
    monkeypatch.setattr(bytepairs, "WINDOW", window)
    monkeypatch.setattr(bytepairs, "REMEMBERED", remembered)
    texts = odd_texts()
    assert bytepairs.Counter(BYTES, bytepairs.unsettled_letters()).count(texts) == library(texts)


def test_counts_of_whole_table(spark):
    got = {r["doc_id"]: r for r in op12_rank_merging(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    for r, n in zip(docs, library([r["text"] or "" for r in docs])):
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 1024)
    assert len(got) == len(docs)


def test_one_round_merges_every_place_of_the_lowest_pair():
    table = bytepairs.PairTable(BYTES)
    words = [b"aaaa", b"aaaaa", b"z", b"the", b" the", b"aaaa" * 300]
    assert bytepairs.surviving(words, table).tolist() == library([w.decode() for w in words])


# --- manifest -------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], r[4])])


def plain_tree(hashes):
    paths, owners, level = [[] for _ in hashes], [[i] for i in range(len(hashes))], list(hashes)
    while len(level) > 1:
        up, up_owners = [], []
        for i in range(0, len(level), 2):
            run = level[i : i + 2]
            for side in range(len(run)):
                met = ("" if side == 0 else run[0], run[1] if side == 0 and len(run) == 2 else "")
                for k in owners[i + side]:
                    paths[k].append(met)
            up.append(sha(*run))
            up_owners.append(sum(owners[i : i + 2], []))
        level, owners = up, up_owners
    return level[0], paths


def plain_manifest(rows):
    by, out = {}, []
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda v: v[:3])
    trees = {x: plain_tree([v[2] for v in by[x]]) for x in langs}
    root, tops = plain_tree([trees[x][0] for x in langs]) if langs else ("", [])
    for lang, top in zip(langs, tops):
        for (_, _, leaf, r), path in zip(by[lang], trees[lang][1]):
            path, folded = path + top, leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                folded = plain_leaf((r[0], r[1], r[2], r[3] + 1, r[4]))
            for a, b in path:
                folded = sha(a, folded, b)
            out.append((r[0], leaf, trees[lang][0], root, sha(*[a + b for a, b in path]), folded, folded == root))
    return by_value(out)


def odd_rows(n):
    langs = [None, "en", "é", "", "de", "en"]
    rows = [((i * 37) % 101 if i % 11 else None, "s" if i % 3 else None, langs[i % 6 if i < 20 else 1], i if i % 4 else None, "t" * i) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("digits, n", [(1, 40), (2, 0), (2, 1), (2, 2), (2, 3), (2, 70), (8, 40)])
def test_manifest_is_the_plain_one(spark, monkeypatch, digits, n):
    monkeypatch.setattr(manifest, "DIGITS", digits)
    rows = odd_rows(n)
    assert by_value(manifest.manifest(spark.createDataFrame(rows, DOCS)).collect()) == plain_manifest(rows)
    con = duck(documents=("doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR", rows))
    assert by_value(con.execute(OP13).fetchall()) == plain_manifest(rows)


def test_one_row_repeated_is_many_leaves(spark):
    rows = [(1, "s", "en", 3, "abc")] * 300
    got = manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert by_value(got) == plain_manifest(rows)


def test_op13_query_equals_sql_and_tampering_shows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = op13_struct_rollup(spark, DIR).collect()
    assert by_value(got) == by_value(con.execute(OP13).fetchall())
    assert all(r["verified"] != (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0) for r in got)


def test_rollup_moves_the_rows_once(spark):
    own = manifest.ranked(manifest.leaves(spark.read.parquet(f"{DIR}/documents.parquet")), ["lang"], ["doc_id", "leaf"])
    nodes = manifest.saved(own.selectExpr("lang", "rank", "size", "struct(leaf AS hash, doc_id, changed) AS node"))
    plan = manifest.rolled(nodes, ["lang"], 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "Join" not in plan
