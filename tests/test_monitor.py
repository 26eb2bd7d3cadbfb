import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from exposure.params import MonitorPolicy
from exposure.streaming import incremental, monitor

SECRET = "super-long-high-entropy-value-ABCDEF1234567890"
DIRTY, OTHER, CLEAN = f"K={SECRET}", f"other {SECRET} text", "nothing here"
REDACTED = "K=[REDACTED]"
T0 = dt.datetime(2024, 1, 1)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([(sha(SECRET),)], "hash string")


def table(spark, rows):
    data = [(k, T0 + dt.timedelta(seconds=t), c) for k, t, c in rows]
    return spark.createDataFrame(data, "surface_id string, ts timestamp, content string")


def listed(df):
    return sorted(
        (r.surface_id, (r.ts - T0).total_seconds(), r.action, r.secrets) for r in df.collect() if r.action != "late"
    )


def stream(spark, tmp_path, registry, batches, policy, recopy=True):
    """Each batch of snapshots arrives as its own file and micro-batch."""
    for i, batch in enumerate(batches):
        table(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema("surface_id string, ts timestamp, content string").parquet(str(tmp_path / "in"))
        monitor.start_scoring(src, registry, str(tmp_path / "scored"), str(tmp_path / "cp1")).awaitTermination()
        acts = monitor.actions(monitor.scored_stream(spark, str(tmp_path / "scored")), policy, "0 seconds", recopy)
        q = acts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp2")
        ).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(monitor.ACTIONS).parquet(str(tmp_path / "out"))


BASIC = [
    ("a", 0, DIRTY), ("a", 10, DIRTY), ("a", 100, CLEAN), ("a", 200, DIRTY), ("a", 210, OTHER), ("a", 400, CLEAN),
    ("b", 5, CLEAN), ("b", 20, OTHER), ("b", 49, CLEAN), ("b", 300, CLEAN), ("c", 0, ""), ("c", 500, CLEAN),
]


def test_score(spark, registry):
    out = {r.ts.second: r for r in monitor.score(table(spark, BASIC[:3]), registry).collect()}
    assert out[0].secrets == 1 and out[0].redacted == REDACTED and out[0].redacted_hash == sha(REDACTED)
    assert out[40].secrets == 0 and out[40].redacted is None
    counted = {r.ts.second: r.secrets for r in monitor.count_only(table(spark, BASIC[:3]), registry).collect()}
    assert counted == {0: 1, 10: 1, 40: 0}


@pytest.fixture(scope="module")
def scored(spark):
    reg = spark.createDataFrame([(sha(SECRET),)], "hash string")
    rows = [tuple(r) for r in monitor.count_only(table(spark, BASIC), reg).collect()]
    return spark.createDataFrame(rows, "surface_id string, ts timestamp, content_hash string, secrets int")


@pytest.mark.parametrize(
    ("policy", "want"),
    [
        (MonitorPolicy(), [("a", 0, "alert"), ("a", 30, "redact"), ("a", 200, "alert"), ("a", 210, "alert"), ("a", 240, "redact"), ("b", 20, "alert")]),
        (MonitorPolicy(redact_after_s=0), [("a", 0, "alert"), ("a", 60, "clear"), ("a", 200, "alert"), ("a", 210, "alert"), ("a", 270, "clear"), ("b", 20, "alert")]),
        (MonitorPolicy(0, 0), [("a", 0, "alert"), ("a", 200, "alert"), ("a", 210, "alert"), ("b", 20, "alert")]),
        (MonitorPolicy(alerts=False), [("a", 30, "redact"), ("a", 240, "redact")]),
        (MonitorPolicy(20, 10), [("a", 0, "alert"), ("a", 10, "clear"), ("a", 200, "alert"), ("a", 210, "alert"), ("a", 220, "clear"), ("b", 20, "alert"), ("b", 30, "clear")]),
        (MonitorPolicy(clear_after_redact=True), [("a", 0, "alert"), ("a", 30, "redact"), ("a", 60, "clear"), ("a", 200, "alert"), ("a", 210, "alert"), ("a", 240, "redact"), ("a", 270, "clear"), ("b", 20, "alert")]),
    ],
)
def test_batch(scored, policy, want):
    """With time lines cut into pieces shorter than the gaps between snapshots, and whole."""
    got = listed(monitor.actions_batch(scored, policy, 7))
    if policy == MonitorPolicy():
        assert got == listed(monitor.actions_batch(scored, policy))
    fixed = [(k, t, a) for k, t, a, _ in got]
    # the snapshot at exactly the time of the action already shows other content
    assert fixed == sorted((k, float(t), a) for k, t, a in want)
    assert {s for *_, s in got} == {1}


def test_stream_equals_batch(spark, registry, tmp_path):
    policy = MonitorPolicy()
    in_time = sorted(BASIC, key=lambda r: r[1])
    batches = [in_time[:7], in_time[7:], [("z", 10_000, CLEAN)], [("z", 20_000, CLEAN)]]
    got = listed(stream(spark, tmp_path, registry, batches, policy, recopy=False))
    want = listed(monitor.actions_batch(monitor.count_only(table(spark, BASIC), registry), policy))
    assert got == want


def test_stream_states(spark, registry, tmp_path):
    """Redacted content showing up is no change, the original coming back is one, late rows are reported."""
    batches = [
        [("a", 0, DIRTY), ("a", 31, REDACTED), ("a", 50, REDACTED), ("a", 60, DIRTY)],
        [("a", 200, CLEAN)],
        [("a", 150, DIRTY), ("q", 10_000, CLEAN)],
        [("q", 20_000, CLEAN)],
    ]
    out = stream(spark, tmp_path, registry, batches, MonitorPolicy())
    assert [(t, a) for _, t, a, _ in listed(out)] == [(0, "alert"), (30, "redact"), (60, "alert"), (90, "redact")]
    texts = monitor.with_content(out, monitor.score(table(spark, batches[0]), registry)).filter("action = 'redact'")
    assert {r.content_out for r in texts.collect()} == {REDACTED}


def test_stream_clear_only(spark, registry, tmp_path):
    batches = [[("a", 0, DIRTY)], [("z", 10_000, CLEAN)], [("z", 20_000, CLEAN)]]
    out = stream(spark, tmp_path, registry, batches, MonitorPolicy(redact_after_s=0))
    assert [(t, a) for _, t, a, _ in listed(out)] == [(0, "alert"), (60, "clear")]


def test_status(spark, registry):
    scored = monitor.count_only(table(spark, BASIC[:5]), registry)
    got = monitor.status(scored, monitor.actions_batch(scored, open_ended=True)).first()
    assert got.secrets == 0 and got.redacted and not got.cleared and (got.last_change - T0).total_seconds() == 210


def test_incremental_residue(spark, registry, tmp_path):
    from exposure.params import PathPolicy, Surface
    from exposure.schema import CORPUS

    def add(name):
        row = (f"/h/{name}", T0, 100, bytearray(f"secrets for you: {DIRTY}".encode()))
        spark.createDataFrame([row], CORPUS).write.mode("append").parquet(str(tmp_path / "corpus"))

    def run():
        src = spark.readStream.schema(CORPUS).parquet(str(tmp_path / "corpus"))
        policy = PathPolicy(surfaces=(Surface("/h"),))
        incremental.start_residue(src, registry, policy, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted((r.basename, r.known_matches) for r in spark.read.parquet(str(tmp_path / "out" / "data" / "*")).collect())

    add("secrets.txt")
    assert run() == [("secrets.txt", 1)]
    add("creds.txt")
    assert run() == [("creds.txt", 1), ("secrets.txt", 1)]


def test_incremental_scrub(spark, registry, tmp_path):
    files = spark.createDataFrame([("f", f"a {DIRTY}\nb")], "file_id string, content string")
    files.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("file_id string, content string").parquet(str(tmp_path / "in"))
    incremental.start_scrub(src, registry, "aa", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    [row] = spark.read.parquet(str(tmp_path / "out" / "data" / "*")).collect()
    assert row.deleted == 1 and SECRET not in row.content


def test_no_actions_but_a_status(spark):
    """With alerts and both timeouts off there is no action, and the status still knows the last dirty change."""
    import datetime as dt

    from pyspark.sql import functions as F

    off = monitor.MonitorPolicy(alerts=False, redact_after_s=0, clear_after_s=0)
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("s", day + dt.timedelta(seconds=k), f"h{k}", n, "", "") for k, n in ((0, 0), (10, 2), (20, 0))]
    scored = spark.createDataFrame(rows, monitor.SCORED)
    acts = monitor.actions_batch(scored, off)
    assert acts.collect() == []
    row = monitor.status(scored, acts).select("secrets", F.unix_timestamp("last_change").alias("t"), "redacted").first()
    assert (row.secrets, row.t, row.redacted) == (0, int(day.timestamp()) + 10, False)


def test_time_lines_are_cut_by_rows(spark):
    """A surface with most rows in one second is in many pieces, and the actions are those of the uncut line."""
    rows = [("hot", T0 + dt.timedelta(microseconds=7 * k), f"h{k // 3 % 40}", k // 3 % 2) for k in range(6000)]
    rows += [("hot", T0 + dt.timedelta(microseconds=7), "h0", 0)] * 500
    rows += [(f"s{k % 5}", T0 + dt.timedelta(hours=k), f"h{k % 3}", k % 3) for k in range(300)]
    scored = spark.createDataFrame(rows, "surface_id string, ts timestamp, content_hash string, secrets int")
    line = monitor.time_line(scored, rows=200)
    pieces = {r["_piece"]: r["count"] for r in line.filter("surface_id = 'hot'").groupBy("_piece").count().collect()}
    assert len(pieces) > 20 and max(pieces.values()) < 1000 and sum(pieces.values()) == 6000
    ordered = [r["_piece"] for r in line.filter("surface_id = 'hot'").orderBy("ts", "content_hash").collect()]
    assert ordered == sorted(ordered)
    policy = MonitorPolicy(redact_after_s=3600)
    assert listed(monitor.actions_batch(line, policy)) == listed(monitor.actions_batch(scored.distinct(), policy))
    assert sorted(monitor.status(line, monitor.actions_batch(line, policy)).collect()) == sorted(
        monitor.status(scored, monitor.actions_batch(scored.distinct(), policy)).collect()
    )
    assert monitor.actions_batch(monitor.time_line(scored.limit(0)), policy).count() == 0


def test_state_and_restart(spark, registry, tmp_path):
    """The state store gives the status; a stream that goes on from it with a new checkpoint acts as an unbroken one."""
    first = [("a", 0, DIRTY), ("a", 40, DIRTY), ("b", 45, DIRTY), ("c", 46, CLEAN)]
    later = [[("a", 50, OTHER), ("b", 60, DIRTY)], [("z", 10_000, CLEAN)], [("z", 20_000, CLEAN)]]
    policy = MonitorPolicy()
    (tmp_path / "whole").mkdir()
    (tmp_path / "before").mkdir()
    whole = listed(stream(spark, tmp_path / "whole", registry, [first, *later], policy, recopy=False))
    before = listed(stream(spark, tmp_path / "before", registry, [first], policy, recopy=False))
    states = monitor.state(spark, str(tmp_path / "before" / "cp2"))
    at = {r.surface_id: (r.secrets, r.last_change and (r.last_change - T0).total_seconds(), r.redacted, r.cleared) for r in monitor.status_of(states).collect()}
    assert at == {"a": (0, 0, True, False), "b": (1, 45, False, False), "c": (0, None, False, False)}
    states.write.parquet(str(tmp_path / "states"))
    initial = spark.read.parquet(str(tmp_path / "states"))
    scored = tmp_path / "after"
    for i, batch in enumerate(later):
        monitor.score(table(spark, batch), registry).write.parquet(str(scored / f"batch={i}"))
        acts = monitor.actions(monitor.scored_stream(spark, str(scored)), policy, "0 seconds", False, initial)
        acts.writeStream.format("parquet").option("path", str(tmp_path / "rest")).option(
            "checkpointLocation", str(tmp_path / "cp3")
        ).trigger(availableNow=True).start().awaitTermination()
    after = listed(spark.read.schema(monitor.ACTIONS).parquet(str(tmp_path / "rest")))
    assert sorted(before + after) == whole
