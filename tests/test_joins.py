"""Heavy keys by measurement, the bitmap before the shuffle, and rules that move no contents."""

import random

import pytest
from pyspark.sql import functions as F

from exposure.operators import joins, known, policy, registry
from exposure.params import Gate, PathPolicy, Surface
from exposure.plans import residue_scan


def sha(i):
    return F.sha2(F.concat(F.lit("k"), i.cast("string")), 256)


@pytest.fixture
def plain_joins(spark):
    """No broadcast and no adaptive help, so a plan shows what it does by itself."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_rows(spark, n=40_000, share=0.9):
    i = F.col("id")
    return spark.range(n).select("id", sha(F.when(i < share * n, 0).otherwise(i % 3000 + 1)).alias("hash"))


def test_one_hash_in_most_rows_is_spread(spark, plain_joins):
    rows = hot_rows(spark)
    lookup = spark.range(2000).select(sha(F.col("id")).alias("hash"), F.lit(1).alias("hit"))
    heavy = joins.heavy_keys(rows)
    (key,) = heavy
    assert key == rows.first()["hash"] and heavy[key] >= 16
    out = joins.join_spread(rows, lookup, heavy, ["id"])
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sum(sizes) / 16
    plain = rows.join(lookup, "hash", "left")
    assert out.agg(F.count("hit"), F.count("*")).first() == plain.agg(F.count("hit"), F.count("*")).first()
    assert max(r[1] for r in plain.groupBy(F.spark_partition_id()).count().collect()) > 10 * sum(sizes) / 16


def test_without_heavy_keys_the_lookup_is_sent_once(spark, plain_joins):
    rows = spark.range(20_000).select("id", sha(F.col("id") % 5000).alias("hash"))
    lookup = spark.range(100).select(sha(F.col("id")).alias("hash"), F.lit(1).alias("hit"))
    assert joins.heavy_keys(rows) == {}
    out = joins.join_spread(rows, lookup, {}, ["id"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20_000
    few = joins.join_spread(hot_rows(spark), lookup, joins.heavy_keys(hot_rows(spark)), ["id"], "left_semi")
    assert few.count() == hot_rows(spark).join(lookup, "hash", "left_semi").count()


def test_rows_without_a_key_do_not_meet(spark, plain_joins):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, sha(F.col("id"))).alias("hash"))
    lookup = spark.range(10).select(sha(F.col("id")).alias("hash"), F.lit(1).alias("hit"))
    out = joins.join_spread(rows, lookup, joins.heavy_keys(rows), ["id"])
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / 16
    assert joins.heavy_keys(rows.filter("id < 0")) == {}


def test_bitmap_lets_all_keys_through_and_few_others(spark):
    keys = spark.range(3000).select(sha(F.col("id")).alias("hash"))
    bitmap = joins.prefix_bitmap(keys)
    asked = spark.range(20_000).select("id", sha(F.col("id")).alias("hash"), bitmap.alias("b"))
    got = asked.select("id", joins.may_be_in(F.col("hash"), F.col("b")).alias("may"))
    assert got.filter("id < 3000 AND NOT may").count() == 0
    assert got.filter("id >= 3000 AND may").count() < 50
    odd = spark.createDataFrame([("000000" + "0" * 58,), ("ffffff" + "0" * 58,), ("7fffff" + "1" * 58,), (None,)], "hash string")
    edge = odd.withColumn("b", joins.prefix_bitmap(odd)).select(joins.may_be_in(F.col("hash"), F.col("b")))
    assert [r[0] for r in edge.collect()] == [True, True, True, False]
    none = odd.withColumn("b", joins.prefix_bitmap(odd.filter("hash IS NULL"))).select(joins.may_be_in(F.col("hash"), F.col("b")))
    assert [r[0] for r in none.collect()] == [False] * 4


def test_only_what_may_be_known_moves(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(40)) for _ in range(400)]
    texts = [(i, " ".join(rng.sample(words, 5) + [words[0]] * (i % 10 > 0))) for i in range(2000)] + [(5000, ""), (5001, None)]
    docs = spark.createDataFrame(texts, "id long, text string")
    store, reg = str(tmp_path / "likely"), str(tmp_path / "reg")
    spark.createDataFrame([(w,) for w in words[:4]], "w string").select(F.sha2("w", 256).alias("hash")).write.parquet(reg)
    reg = spark.read.schema("hash string").parquet(reg)
    want = sorted(map(tuple, known.known_per_text(docs, ["id"], "text", reg).collect()))
    assert sorted(map(tuple, known.known_measured(docs, ["id"], "text", reg, store=store).collect())) == want
    moved = spark.read.parquet(store).select(F.explode("_hashes").alias("h"))
    hits = sum(n for _, n in want)
    assert hits <= moved.count() <= hits + 5 and moved.count() < 2500


def test_rules_move_no_contents(spark, monkeypatch):
    files = spark.createDataFrame(
        [(f"/h/{d}/f{i}{e}", i, 9, "text") for d in ("a", "b") for i in range(20) for e in (".txt", ".log")], "path string, m long, size long, content string"
    ).withColumn("modified", F.timestamp_seconds("m"))
    rules = policy.rules_from_lines(spark.createDataFrame([("/h/a", 0, "*.log"), ("/h/a", 1, "!f1*"), ("/h/a", 2, "f3*")], "root string, rule_no int, line string"))
    place = PathPolicy(surfaces=(Surface("/h/a"), Surface("/h/b")))

    def run():
        return residue_scan.examined(files, place, rules)

    def paths(df):
        return sorted(r.path for r in df.select("path").collect())

    placed = residue_scan.with_surface(files, place).withColumn("is_dir", F.lit(False))
    want = paths(policy.mark_ignored(placed, rules).filter("NOT ignored"))
    assert paths(run()) == want and len(want) < 80
    plan = run()._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert not any("content" in x for x in moves) and "BroadcastHashJoin" in plan
    # Beyond the limit paths are decided on first.
    monkeypatch.setattr(policy, "small_enough", lambda rules: False)
    assert paths(run()) == want


def test_size_of_a_table_is_checked(spark):
    assert joins.small_enough(spark.range(10)) and joins.small_enough(spark.range(0))
    assert not joins.small_enough(spark.range(1000), 1000) and not joins.small_enough(spark.range(1).select(F.repeat(F.lit("x"), 5000).alias("x")), 1000)


@pytest.mark.parametrize("run", [10_000, 7])
def test_repeated_questions_come_in_runs(spark, monkeypatch, run):
    monkeypatch.setattr(registry, "RUN", run)
    pairs = spark.range(3).select(sha(F.col("id")).alias("hash"), F.lit("p").alias("project_id"))
    asked = spark.range(100).select(sha(F.lit(1)).alias("hash_hex")).unionByName(spark.range(5).select(F.lit("zz").alias("hash_hex")))
    asked = asked.unionByName(spark.sql("SELECT CAST(NULL AS string) AS hash_hex"))
    got = registry.check_hex(asked, pairs).groupBy("hash_hex", "known").count().collect()
    assert sorted((r["known"], r["count"]) for r in got) == [(False, 1), (False, 5), (True, 100)]


def test_gate_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "export K=abcdabcd12341234abcdabcd12341234")], "id long, text string")
    reg = docs.select(F.sha2(F.lit("abcdabcd12341234abcdabcd12341234"), 256).alias("hash"))
    low = known.known_measured(docs, ["id"], "text", reg, Gate(8, 2.0), str(tmp_path / "low"))
    assert [tuple(r) for r in low.collect()] == [(1, 1)]
