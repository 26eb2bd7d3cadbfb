"""Snapshots that name their content, and that texts are neither sorted nor joined to snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure.functions.extract import candidate_hashes
from exposure.params import Gate
from exposure.streaming import monitor

SECRET = "k3Jx9Qp7Lm2Zt8Vb5Nc1Rd4Hf6Wg0Ys"
LOW = Gate(min_len=16, min_entropy=3.0)


def frames(spark):
    contents = spark.createDataFrame([(1, f"token={SECRET}"), (2, "nothing"), (3, "nothing"), (4, None)], "content_id long, content string")
    named = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 9), ("b", 1, 3), ("b", 2, 4), ("b", 3, None), ("b", 4, 1)], "surface_id string, t long, content_id long")
    named = named.select("surface_id", F.timestamp_seconds("t").alias("ts"), "content_id")
    plain = named.join(contents, "content_id", "left").select("surface_id", "ts", "content")
    registry = spark.createDataFrame([(f"token={SECRET}",)], "t string").select(F.explode(candidate_hashes("t", LOW)).alias("hash"))
    return named, contents, plain, registry


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_named_snapshots_score_as_plain_ones(spark):
    named, contents, plain, registry = frames(spark)
    counted = rows(monitor.count_named(named, contents, registry, LOW))
    assert counted == rows(monitor.count_only(plain, registry, LOW)) and len(counted) == 7
    assert sum(int(r[3]) > 0 for r in counted) == 2
    assert rows(monitor.score_named(named, contents, registry, LOW)) == rows(monitor.score(plain, registry, LOW))


def test_contents_are_folded_without_a_sort_of_texts(spark):
    _, _, plain, _ = frames(spark)
    plan = monitor._contents(monitor._hashed(plain))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
