import hashlib

import pytest
from pyspark.sql import functions as F

from exposure.operators import known, registry
from exposure.plans import rescan
from exposure.sources import envfile, vault


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


PAIRS = "hash string, project_id string, seen_at timestamp"


@pytest.fixture
def pairs(spark):
    rows = [("a", "p1", 1), ("a", "p2", 5), ("a", "p1", 3), ("b", "p1", 2), ("c", "p3", 9)]
    df = spark.createDataFrame([(sha(h), p, t) for h, p, t in rows], "hash string, project_id string, t long")
    return registry.build(df.select("hash", "project_id", F.timestamp_seconds("t").alias("seen_at")))


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_build_and_counts(pairs):
    assert pairs.count() == 4
    per = {r.hash: (r.n_projects, r.last_seen.second) for r in registry.per_hash(pairs).collect()}
    assert per == {sha("a"): (2, 5), sha("b"): (1, 2), sha("c"): (1, 9)}
    assert registry.snapshot(pairs).first().asDict() == {
        "tracked_hashes": 3, "duplicate_hashes": 1, "scan_state": "completed"
    }
    assert abs(registry.approximate_size(pairs).first()[0] - 3) <= 1


def test_entries_page_large_sets(spark):
    many = spark.range(5000).select(
        F.lit(sha("hot")).alias("hash"), F.col("id").cast("string").alias("project_id"),
        F.timestamp_seconds("id").alias("seen_at"),
    )
    pages = registry.entries(many, page_size=1000).collect()
    assert sorted(p for r in pages for p in r.projects) == sorted(str(i) for i in range(5000))
    assert len(pages) == 5 and {r.n_projects for r in pages} == {5000}
    assert max(len(r.projects) for r in pages) < 1300


def test_duplicates_and_names(spark, pairs):
    meta = spark.createDataFrame([("p1", "work/api"), ("p2", "")], "project_id string, display_name string")
    got = as_set(registry.with_display_names(registry.duplicates(pairs), meta), "project_id", "display_name", "n_projects")
    assert got == {("p1", "work/api", 2), ("p2", ".../p2", 2)}


def test_projects_of(spark, pairs):
    wanted = spark.createDataFrame([(sha("a"),), (sha("zz"),)], "hash string")
    assert as_set(registry.projects_of(wanted, pairs), "project_id") == {("p1",), ("p2",)}


def test_check_hex(spark, pairs):
    asked = [sha("a"), sha("a").upper(), sha("x"), sha("a")[:-1], "zz" + sha("a")[2:], "", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(asked)], "i int, hash_hex string")
    got = {r.i: r.known for r in registry.check_hex(df, pairs).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    again = spark.createDataFrame([(sha("a"),)] * 5 + [(None,)] * 2 + [("x",)], "hash_hex string")
    assert sorted(r.known for r in registry.check_hex(again, pairs).collect()) == [False] * 3 + [True] * 5


def test_removal(spark, pairs):
    gone = spark.createDataFrame([(sha("a"), "p1"), (sha("c"), "p3")], "hash string, project_id string")
    assert as_set(registry.remove_pairs(pairs, gone), "hash", "project_id") == {(sha("a"), "p2"), (sha("b"), "p1")}
    assert as_set(registry.clear_project(pairs, "p1"), "hash") == {(sha("a"),), (sha("c"),)}


def test_fingerprints(spark, pairs):
    def fp(fn, df):
        return fn(df).first().regfp

    shuffled = pairs.repartition(3).orderBy(F.rand())
    fn = registry.fingerprint
    assert fp(fn, pairs) == fp(fn, shuffled)
    assert fp(fn, pairs) != fp(fn, pairs.filter(F.col("hash") != sha("c")))
    assert fp(fn, pairs.filter("false")) == "0"


def test_env_file(spark):
    content = "\n".join(
        [
            "# comment", "", "   ", "SIMPLE=plainvalue", 'QUOTED="double quoted value"', "SINGLE='single quoted'",
            "WITH_EQUALS=key=value=more", "EMPTY_VALUE=", "NO_EQUALS_LINE", "TRAILING=value # not stripped",
            "PATH=/bin", "LC_ALL=x", "MY_NONSECRET=1", "TEST_X=1", " #K=v", "Q=''\"",
        ]
    )
    long = "K=v\nL=" + "x" * 70_000
    df = spark.createDataFrame(
        [("/h/p/.env", content), ("/h/q/.env", long)], "path string, content string"
    ).withColumn("modified", F.timestamp_seconds(F.lit(1)))
    got = {r.hash for r in envfile.contributions(df).collect()}
    assert got == {
        sha(v) for v in ("plainvalue", "double quoted value", "single quoted", "key=value=more", "value # not stripped", "v", "x" * 70_000)
    }
    assert {r.project_id for r in envfile.contributions(df).collect()} == {sha("/h/p")[:16], sha("/h/q")[:16]}
    assert {r.project_id for r in envfile.contributions(df, "source").collect()} == {sha("logical:env")[:16]}
    assert envfile.long_lines(df).count() == 1


def test_vault(spark):
    items = (
        '[{"login":{"password":"supersecret123","totp":"no"}},{"notes":"another very secret note value"},'
        '{"notes":"12345678"},{"fields":[{"value":"customfieldsecret"},{"value":9},7]},'
        '{"password":"top-level-pw-secret-9876543210"},null]'
    )
    df = spark.createDataFrame([(items,), ('{"a":1}',), ("[1]",), ("nonsense",)], "items string").withColumn(
        "exported_at", F.timestamp_seconds(F.lit(1))
    )
    got = {r.hash for r in vault.contributions(df).collect()}
    values = ["supersecret123", "another very secret note value", "customfieldsecret", "top-level-pw-secret-9876543210"]
    assert got == {sha(v) for v in values}
    assert len(vault.contributions(df, ignore=("secret1", "")).collect()) == 3
    assert vault.invalid(df).count() == 3


def test_rescan_replaces(spark, pairs):
    one = spark.createDataFrame([(sha("n"), "s", 1), (sha("n"), "s", 1), (sha("a"), "s", 1)], "hash string, project_id string, t long")
    source = one.select("hash", "project_id", F.timestamp_seconds("t").alias("seen_at"))
    after = rescan.rescan({"env": source})
    assert as_set(after, "hash") == {(sha("n"),), (sha("a"),)}
    errors = spark.createDataFrame([("bad",), ("bad",)], "error string")
    rows = {
        (r.stage, r.source, r.before, r.after, r.hashes)
        for r in rescan.delta(pairs, rescan.collect_sources({"env": source}), errors).collect()
    }
    assert rows == {("registry", None, 3, 2, None), ("collect", "env", None, None, 3), ("errors", None, None, None, 2)}
    assert as_set(registry.changes(pairs, after), "change", "hash") == {
        ("added", sha("n")), ("removed", sha("b")), ("removed", sha("c"))
    }


def test_known_counts_keep_zero_rows(spark):
    secret = "super-long-high-entropy-value-ABCDEF1234567890"
    df = spark.createDataFrame([(1, f"A={secret}\nB={secret}"), (2, "nothing"), (3, None)], "id int, text string")
    reg = spark.createDataFrame([(sha(secret),)], "hash string")
    assert as_set(known.known_per_text(df, ["id"], "text", reg), "id", "known") == {(1, 1), (2, 0), (3, 0)}


def test_hot_secret_in_every_text(spark):
    """One secret held by all rows is counted in full."""
    secret = "super-long-high-entropy-value-ABCDEF1234567890"
    df = spark.range(3000).select("id", F.concat(F.lit(f"K={secret}\nid "), F.col("id").cast("string")).alias("text"))
    reg = spark.createDataFrame([(sha(secret),)], "hash string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert known.known_per_text(df, ["id"], "text", reg).agg(F.sum("known")).first()[0] == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_redaction(spark):
    short, long = "ABCDEFGHIJKLMNOPQRSTU123456", "ABCDEFGHIJKLMNOPQRSTU123456-tail-xyz9"
    text = f"one {short} two {long} three"
    df = spark.createDataFrame([(1, text), (2, "clean")], "id int, text string")
    reg = spark.createDataFrame([(sha(short),), (sha(long),)], "hash string")
    plain = {r.id: (r.text, r.secrets) for r in known.redact_texts(df, ["id"], "text", reg).collect()}
    assert plain[2] == ("clean", 0)
    assert plain[1] == ("one [REDACTED] two [REDACTED]-tail-xyz9 three", 2)
    better = {r.id: r.text for r in known.redact_texts(df, ["id"], "text", reg, longest_first=True).collect()}
    assert better[1] == "one [REDACTED] two [REDACTED] three"
    again = known.redact_texts(spark.createDataFrame([(1, better[1])], "id int, text string"), ["id"], "text", reg)
    assert again.first().text == better[1]
