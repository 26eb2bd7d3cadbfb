"""Rescans with failing sources, and the fingerprint that follows changes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from exposure.operators import registry
from exposure.params import PathPolicy, Surface
from exposure.plans import full_rescan, residue_scan
from exposure.plans.full_rescan import Source
from exposure.sources import sinks

PAIRS = "hash string, project_id string, seen_at timestamp"


def pairs(spark, *hashes):
    return spark.createDataFrame([(h, "p", None) for h in hashes], PAIRS)


def errors(spark, *messages):
    return spark.createDataFrame([(m,) for m in messages], "error string")


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def test_a_failing_source_leaves_the_others(spark):
    sources = [
        Source("env", pairs(spark, "a", "b", "b"), errors(spark, "f: denied", "f: denied", "g: gone")),
        Source("vault", pairs(spark, "c"), failure="locked"),
        Source("pages", pairs(spark, "b", "d")),
        Source("empty", pairs(spark)),
        Source("off", pairs(spark, "z"), errors(spark, "never"), enabled=False),
        Source("bare", failure="not set up"),
    ]
    got = sorted((tuple(r) for r in full_rescan.report(pairs(spark, "a", "x", "x"), sources).collect()), key=key)
    want = [
        ("registry", None, 2, 3, None, 2, 1, None, None),
        ("collect", "env", None, None, 3, None, None, None, None),
        ("collect", "pages", None, None, 2, None, None, None, None),
        ("collect", "empty", None, None, 0, None, None, None, None),
        ("errors", "env", None, None, 2, None, None, "f: denied", None),
        ("errors", "env", None, None, 1, None, None, "g: gone", None),
        ("errors", "vault", None, None, 1, None, None, "locked", None),
        ("errors", "bare", None, None, 1, None, None, "not set up", None),
        ("state", None, None, None, None, None, None, None, "failed"),
    ]
    assert got == sorted(want, key=key)
    assert {r["hash"] for r in full_rescan.rescan(sources).select("hash").collect()} == {"a", "b", "d"}


def test_a_rescan_without_errors_is_completed(spark):
    got = full_rescan.report(pairs(spark), [Source("env", pairs(spark, "a"))])
    by = {r["stage"]: r for r in got.collect()}
    assert by["state"]["state"] == "completed" and (by["registry"]["before"], by["registry"]["after"]) == (0, 1)
    nothing = full_rescan.report(pairs(spark, "a"), [])
    assert {r["stage"] for r in nothing.collect()} == {"registry", "state"} and full_rescan.rescan([]) is None


def test_env_files_of_a_corpus(spark):
    corpus = spark.createDataFrame(
        [("/r/a/.env", "K=v1", None), ("/r/b/.env", None, "PermissionError: denied"), ("/else/.env", "K=v3", None), ("/r/x.txt", "K=v4", None)],
        "path string, content string, error string",
    ).withColumn("modified", F.timestamp_seconds(F.lit(5)))
    one = full_rescan.env_source(corpus, PathPolicy(roots=("/r",)))
    assert [r["hash"] for r in one.contributions.collect()] == [hashlib.sha256(b"v1").hexdigest()]
    assert [r["error"] for r in one.errors.collect()] == ["PermissionError: denied"]
    assert full_rescan.env_source(corpus, PathPolicy(roots=())).failure == "no roots configured"
    off = full_rescan.env_source(corpus, PathPolicy(roots=("/r",), roots_enabled=False))
    assert full_rescan.report(pairs(spark, "a"), [off]).filter("stage = 'registry'").first()["removed"] == 1


def test_each_source_is_read_once(spark, tmp_path):
    pairs(spark, "a", "b").write.parquet(str(tmp_path / "src"))
    stored = spark.read.parquet(str(tmp_path / "src"))
    out = full_rescan.report(pairs(spark, "a"), [Source("env", stored)]).filter("stage IN ('registry', 'collect')")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def plain_state(hashes):
    lanes = [0] * 8
    for h in set(hashes):
        d = hashlib.sha256(("set:" + h).encode()).hexdigest()
        lanes = [(x + int(d[8 * i : 8 * i + 8], 16)) % (1 << 32) for i, x in enumerate(lanes)]
    return len(set(hashes)), lanes


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprint_follows_changes(spark, seed):
    rng = random.Random(seed)
    every = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    old, new = rng.sample(every, 200), rng.sample(every, 180)
    state = registry.set_state(pairs(spark, *old, *old[:20]))
    assert tuple(state.first()) == plain_state(old)
    moved = registry.updated_state(state, registry.changes(pairs(spark, *old), pairs(spark, *new)))
    assert tuple(moved.first()) == plain_state(new) == tuple(registry.set_state(pairs(spark, *reversed(new))).first())
    assert registry.state_fingerprint(moved).first() == registry.state_fingerprint(registry.set_state(pairs(spark, *new))).first()
    plan = registry.set_state(pairs(spark, *old))._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan


def test_fingerprint_of_nothing(spark):
    empty = registry.set_state(pairs(spark))
    assert tuple(empty.first()) == (0, [0] * 8) and registry.state_fingerprint(empty).first()["regfp"] == "0"
    gone = registry.updated_state(registry.set_state(pairs(spark, "a")), registry.changes(pairs(spark, "a"), pairs(spark)))
    assert registry.state_fingerprint(gone).first()["regfp"] == "0"
    one = registry.state_fingerprint(registry.set_state(pairs(spark, "a"))).first()
    assert one != registry.state_fingerprint(registry.set_state(pairs(spark, "b"))).first()


def test_summary_reads_texts_once(spark, tmp_path):
    data = [(f"/h/s{i % 3}/f{i}_password.txt", i, 5, "x" * 5) for i in range(30)]
    spark.createDataFrame(data, "path string, m long, size long, content string").withColumn("modified", F.timestamp_seconds("m")).write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    place = PathPolicy(surfaces=(Surface("/h/s0"), Surface("/h/s1")))
    found = residue_scan.scan(corpus, pairs(spark).select("hash"), place)
    out = residue_scan.stored_summary(found, corpus.select("path"), place, str(tmp_path / "out"), "1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "ReadSchema: struct<path:string>" in plan
    got, want = out.first(), residue_scan.summary(found, residue_scan.examined(corpus, place), residue_scan.scanned_directories(corpus, place)).first()
    assert got == want and (got["findings"], got["examined"], got["scanned"]) == (20, 20, 2)
    assert sinks.latest_version(spark, str(tmp_path / "out")).count() == 20
