"""Watching surfaces: which snapshots hold known secrets, and what to do about it in time.

Two stages, so that no plaintext reaches the state store:

1. ``score``: snapshots -> content hash, number of known secrets, redacted text. Plain columns
   and one registry join, the same code for a batch and for each micro-batch.
2. ``actions``: a keyed state machine over the scored rows. Its state holds hashes, counts and
   times. Timers are in event time.

``actions_batch`` computes the same actions from a bounded table with window functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from exposure.functions.extract import candidate_hashes
from exposure.operators.joins import join_by_hash
from exposure.operators.known import known_candidates, known_hashes_by_id, known_values, replace_all
from exposure.operators.timeline import PIECE_ROWS, cut, with_neighbour
from exposure.params import Gate, MonitorPolicy
from exposure.schema import ACTIONS, SCORED
from exposure.shared import folder

# Fixed value: SHA-256 of nothing, the content left by a clear.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
DAY = 86_400


def _hashed(snapshots: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return snapshots.select("surface_id", "ts", F.sha2(content, 256).alias("content_hash"), content.alias("content"))


def _contents(hashed: DataFrame) -> DataFrame:
    """Each content once. A surface shows the same content for most of its snapshots, so this is
    far less text to search; repeats within a task fold before the shuffle. Hash and content are both keys, as
    a first content per hash would be found by sorting all texts."""
    return hashed.select("content_hash", "content").distinct()


def _on_snapshots(hashed: DataFrame, per_content: DataFrame) -> DataFrame:
    """Bring per-content facts to the narrow snapshot rows; a hot content is spread."""
    rows = hashed.select("surface_id", "ts", "content_hash")
    return join_by_hash(rows, per_content, ["surface_id", "ts"], key="content_hash")


def score(snapshots: DataFrame, registry: DataFrame, gate: Gate = Gate(), placeholder: str = "[REDACTED]") -> DataFrame:
    """``surface_id, ts, content_hash, secrets, redacted, redacted_hash`` of snapshots.

    The redacted text is kept only where there is something to redact.
    """
    hashed = _hashed(snapshots)
    return _with_redacted(_on_snapshots(hashed, _redacted(_contents(hashed), registry, gate, placeholder)))


def _redacted(contents: DataFrame, registry: DataFrame, gate: Gate, placeholder: str) -> DataFrame:
    """``content_hash, secrets, redacted, redacted_hash`` of the contents that hold known secrets."""
    found = known_hashes_by_id(
        contents.select("content_hash", candidate_hashes("content", gate).alias("_hashes")),
        ["content_hash"], "_hashes", registry,
    )
    dirty = contents.join(found, "content_hash")
    values = known_candidates("content", F.col("known_hashes"), gate)
    return dirty.select(
        "content_hash",
        F.size("known_hashes").alias("secrets"),
        replace_all(F.col("content"), values, placeholder).alias("redacted"),
    ).withColumn("redacted_hash", F.sha2("redacted", 256))


def _with_redacted(rows: DataFrame) -> DataFrame:
    return rows.select(
        "surface_id", "ts", "content_hash", F.coalesce("secrets", F.lit(0)).alias("secrets"), "redacted", "redacted_hash"
    )


def count_only(snapshots: DataFrame, registry: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """``surface_id, ts, content_hash, secrets``: the score without redacted text."""
    hashed = _hashed(snapshots)
    return _with_count(_on_snapshots(hashed, _counts(_contents(hashed), registry, gate)))


def _counts(contents: DataFrame, registry: DataFrame, gate: Gate) -> DataFrame:
    """``content_hash, secrets`` of the contents that hold known secrets."""
    hashes = contents.select("content_hash", candidate_hashes("content", gate).alias("_hashes"))
    rows = hashes.select("content_hash", F.explode_outer("_hashes").alias("hash")).filter(F.col("hash").isNotNull())
    return known_values(rows, registry, ["content_hash"]).groupBy("content_hash").agg(
        F.count(F.lit(1)).cast("int").alias("secrets")
    )


def _with_count(rows: DataFrame) -> DataFrame:
    return rows.select("surface_id", "ts", "content_hash", F.coalesce("secrets", F.lit(0)).alias("secrets"))


# --- snapshots that name stored contents ---------------------------------------------------------


def scored_contents(contents: DataFrame, registry: DataFrame, gate: Gate = Gate(), store: str | None = None) -> DataFrame:
    """``content_id, content_hash, secrets`` of ``contents (content_id, content)``, stored. Ids must be unique; equal contents are searched once."""
    spark = contents.sparkSession
    hashed = _hashed_contents(contents)
    counts = _counts(_contents(hashed), registry, gate)
    scores = hashed.select("content_id", "content_hash").join(counts, "content_hash", "left").select(
        "content_id", "content_hash", F.coalesce("secrets", F.lit(0)).alias("secrets")
    )
    path = store or folder(spark, "contents-")
    scores.write.parquet(path)
    return spark.read.schema(scores.schema).parquet(path)


def _hashed_contents(contents: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return contents.select("content_id", F.sha2(content, 256).alias("content_hash"), content.alias("content"))


def count_named(snapshots: DataFrame, contents: DataFrame, registry: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """As ``count_only``, for snapshots that name their content: ``surface_id, ts, content_id`` and ``content_id, content``.

    A snapshot of no known content shows nothing. Texts are hashed and searched once each, however many snapshots show them, and never
    meet the snapshots: only ids, hashes and counts are joined. Contents that no snapshot names are left out before the search."""
    scores = scored_contents(_named(contents, snapshots), registry, gate)
    return _with_count(_on_named(snapshots, scores))


def _named(contents: DataFrame, snapshots: DataFrame) -> DataFrame:
    return contents.join(snapshots.select("content_id").distinct(), "content_id", "left_semi")


def _on_named(snapshots: DataFrame, scores: DataFrame) -> DataFrame:
    """Facts per ``content_id`` on the snapshots; a content shown very often is spread."""
    rows = snapshots.select("surface_id", "ts", F.col("content_id").cast("string").alias("content_id"))
    named = scores.withColumn("content_id", F.col("content_id").cast("string"))
    joined = join_by_hash(rows, named, ["surface_id", "ts"], key="content_id")
    return joined.withColumn("content_hash", F.coalesce("content_hash", F.lit(EMPTY_HASH)))


def score_named(
    snapshots: DataFrame, contents: DataFrame, registry: DataFrame, gate: Gate = Gate(), placeholder: str = "[REDACTED]"
) -> DataFrame:
    """As ``score``, for snapshots that name their content (see ``count_named``)."""
    hashed = _hashed_contents(_named(contents, snapshots))
    redacted = _redacted(_contents(hashed), registry, gate, placeholder)
    return _with_redacted(_on_named(snapshots, hashed.select("content_id", "content_hash").join(redacted, "content_hash", "left")))


def start_scoring(
    snapshots: DataFrame, registry: DataFrame, out: str, checkpoint: str, gate: Gate = Gate(),
    placeholder: str = "[REDACTED]", trigger: dict | None = None, contents: DataFrame | None = None,
) -> StreamingQuery:
    """Score a snapshot stream into parquet. A replayed micro-batch overwrites its own folder.

    ``registry`` is read by every micro-batch and should be a stored table. With ``contents (content_id, content)`` the snapshots name
    theirs (``score_named``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if contents is None:
            scored = score(batch, registry, gate, placeholder)
        else:
            scored = score_named(batch, contents, registry, gate, placeholder)
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        snapshots.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def scored_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(f"{SCORED}, batch int").parquet(path).drop("batch")


# --- actions ------------------------------------------------------------------------------------


def due_action(policy: MonitorPolicy) -> tuple[str, int] | None:
    """The one timed action of an epoch: the earlier of redact and clear, redact on a tie.

    After either one no secret is left, so the other does not follow.
    """
    due = [
        (seconds, rank, name)
        for seconds, rank, name in (
            (policy.redact_after_s, 0, "redact"),
            (policy.clear_after_s, 1, "clear"),
        )
        if seconds > 0
    ]
    if not due:
        return None
    seconds, _, name = min(due)
    return name, seconds


def follow_up_clear(policy: MonitorPolicy) -> int | None:
    """Seconds to a clear that follows a redact, where that is wanted."""
    first = due_action(policy)
    wanted = policy.clear_after_redact and first is not None and first[0] == "redact"
    return policy.clear_after_s if wanted and policy.clear_after_s > policy.redact_after_s else None


EVENT_ORDER = ["ts", "content_hash"]


def time_line(scored: DataFrame, rows: int = PIECE_ROWS) -> DataFrame:
    """The scored snapshots, stored once in pieces of about ``rows`` rows, for ``actions_batch`` and ``status``.

    A surface with any share of all snapshots, even in one second, is cut. Snapshots of one surface, time and content are one row."""
    narrow = scored.select("surface_id", "ts", "content_hash", "secrets").dropDuplicates(["surface_id", *EVENT_ORDER])
    return cut(narrow, "surface_id", EVENT_ORDER, rows)


def _bucket(scored: DataFrame, bucket_s: int) -> Column:
    """The piece of a stored time line, else the stretch of ``bucket_s`` seconds."""
    return F.col("_piece") if "_piece" in scored.columns else F.floor(F.unix_micros("ts") / (bucket_s * 1_000_000))


def _changes(scored: DataFrame, bucket_s: int) -> DataFrame:
    """The snapshots whose content is not that of the one before."""
    seen = with_neighbour(scored, "surface_id", EVENT_ORDER, F.col("content_hash"), "_prev", _bucket(scored, bucket_s))
    return seen.filter(~F.col("content_hash").eqNullSafe(F.col("_prev"))).drop("_prev")


def actions_batch(
    scored: DataFrame, policy: MonitorPolicy = MonitorPolicy(), bucket_s: int = DAY, open_ended: bool = False
) -> DataFrame:
    """Actions over a bounded table of scored snapshots.

    A run of equal content is one epoch. An epoch with secrets raises an alert when it begins and
    gets its timed action if its content is still there by then. As in the stream, an action is taken once its time has come:
    the last snapshot of all surfaces is the clock. ``open_ended`` also gives what is due after it.
    Rows of ``time_line`` are worked on in its pieces, others in stretches of ``bucket_s`` seconds of a surface.
    """
    epochs = with_neighbour(
        _changes(scored, bucket_s), "surface_id", EVENT_ORDER, F.col("ts"), "_until", _bucket(scored, bucket_s), forward=True
    )

    def after(seconds: int):
        return F.col("ts") + F.make_dt_interval(secs=F.lit(float(seconds)))

    steps = []
    if policy.alerts:
        steps.append(F.struct(F.col("ts").alias("ts"), F.lit("alert").alias("action")))
    timed = []
    if (first := due_action(policy)) is not None:
        timed.append(first)
    if (later := follow_up_clear(policy)) is not None:
        timed.append(("clear", later))
    for name, seconds in timed:
        stable = F.col("_until").isNull() | (F.col("_until") > after(seconds))
        steps.append(F.when(stable, F.struct(after(seconds).alias("ts"), F.lit(name).alias("action"))))
    none = F.array().cast("array<struct<ts:timestamp,action:string>>")
    listed = F.filter(F.array(*steps), lambda s: s.isNotNull()) if steps else none
    dirty = epochs.filter(F.col("secrets") > 0)
    taken = dirty.select(
        "surface_id", F.explode(listed).alias("_a"), "secrets", "content_hash", F.col("ts").alias("changed_at")
    ).select("surface_id", "_a.ts", "_a.action", "secrets", "content_hash", "changed_at")
    return taken if open_ended else taken.filter(F.col("ts") <= scored.agg(F.max("ts")).scalar())


def status(scored: DataFrame, actions: DataFrame, bucket_s: int = DAY) -> DataFrame:
    """Per surface: secrets now on it, last change that brought one (whether or not any action followed), and what was done
    since."""
    events = scored.select(
        "surface_id", "ts", F.lit(0).alias("rank"), "secrets", F.lit("snapshot").alias("action")
    ).unionByName(
        actions.filter(F.col("action") != "alert").select(
            "surface_id", "ts", F.lit(1).alias("rank"), F.lit(0).alias("secrets"), "action"
        )
    )
    last = events.groupBy("surface_id").agg(
        F.max_by(F.struct("secrets", "action"), F.struct("ts", "rank")).alias("l")
    )
    dirty = _changes(scored, bucket_s).filter(F.col("secrets") > 0)
    changed = dirty.groupBy("surface_id").agg(F.max("ts").alias("last_change"))
    return last.join(changed, "surface_id", "left").select(
        "surface_id",
        F.col("l.secrets").alias("secrets"),
        "last_change",
        (F.col("l.action") == "redact").alias("redacted"),
        (F.col("l.action") == "clear").alias("cleared"),
    )


STATE = "hash string, changed_us long, secrets int, redacted boolean, cleared boolean, ts_us long, source string, redacted_hash string, last_us long"

STATE_FIELDS = [f.split()[0] for f in STATE.split(", ")]


class SurfaceMonitor(StatefulProcessor):
    """One surface: change detection, alert, timed redact and clear.

    The state is (last content hash, change time, secrets, flags, last event time, hash of the
    snapshot that began the epoch, hash of its redacted text, time of the last change that brought a secret).
    """

    def __init__(self, redact_s: int, clear_s: int, alerts: bool, clear_after_redact: bool, recopy: bool):
        self.redact_us = redact_s * 1_000_000
        self.clear_us = clear_s * 1_000_000
        self.alerts = alerts
        self.clear_after_redact = clear_after_redact
        self.recopy = recopy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("surface", STATE)

    def close(self) -> None:
        pass

    def _due(self, s: dict) -> list[tuple[int, str]]:
        """Times of the actions still open in this epoch, earliest first."""
        if s["changed_us"] is None:
            return []
        out = []
        if s["secrets"] > 0 and not s["redacted"] and self.redact_us > 0:
            out.append((s["changed_us"] + self.redact_us, "redact"))
        may_clear = s["secrets"] > 0 or (self.clear_after_redact and s["redacted"])
        if may_clear and not s["cleared"] and self.clear_us > 0:
            out.append((s["changed_us"] + self.clear_us, "clear"))
        return sorted(out, key=lambda a: (a[0], a[1] != "redact"))

    def _fire(self, key: str, s: dict, now_us: int, strict: bool, rows: list) -> None:
        """Carry out what is due before ``now_us`` (or at it, when driven by a timer)."""
        while due := self._due(s):
            at, action = due[0]
            if at > now_us or (strict and at == now_us):
                return
            rows.append((key, at, action, s["secrets"], s["source"], s["changed_us"]))
            s["secrets"] = 0
            if action == "redact":
                s["redacted"], s["hash"] = True, s["redacted_hash"]
            else:
                s["cleared"], s["hash"] = True, EMPTY_HASH
            if action == "clear" or not self.clear_after_redact:
                return

    def _observe(self, key: str, s: dict, ts_us: int, content_hash: str, secrets: int, redacted_hash: str | None, rows: list) -> None:
        if s["ts_us"] is not None and ts_us < s["ts_us"]:
            rows.append((key, ts_us, "late", secrets, content_hash, None))
            return
        acted = s["redacted"] or s["cleared"]
        if content_hash != s["hash"]:
            self._fire(key, s, ts_us, True, rows)
            acted = s["redacted"] or s["cleared"]
        s["ts_us"] = ts_us
        same = content_hash == s["hash"] or (not self.recopy and acted and content_hash == s["source"])
        if same:
            self._fire(key, s, ts_us, False, rows)
            return
        s["hash"] = s["source"] = content_hash
        s["secrets"] = secrets
        s["redacted"] = s["cleared"] = False
        s["redacted_hash"] = redacted_hash
        s["changed_us"] = ts_us if s["secrets"] > 0 else None
        s["last_us"] = s["last_us"] if s["changed_us"] is None else ts_us
        if s["secrets"] > 0 and self.alerts:
            rows.append((key, ts_us, "alert", s["secrets"], content_hash, ts_us))

    def _load(self) -> dict:
        held = self.cell.get()
        return dict(zip(STATE_FIELDS, (None, None, 0, False, False, None, None, None, None) if held is None else held))

    def _timers(self, s: dict) -> list[int]:
        return [-(-at // 1000) for at, _ in self._due(s)]

    def _store(self, s: dict, before: list[int]) -> None:
        """Store the state. ``before``: the timers of the state as it was loaded, which are known from it and need not be listed."""
        self.cell.update(tuple(s.values()))
        now = self._timers(s)
        for timer in set(before) - set(now):
            self.handle.deleteTimer(timer)
        for timer in now:
            self.handle.registerTimer(timer)

    @staticmethod
    def _frame(rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            columns = dict(zip(["surface_id", "ts", "action", "secrets", "content_hash", "changed_at"], zip(*rows)))
            for c in ("ts", "changed_at"):
                columns[c] = np.array(["NaT" if t is None else t for t in columns[c]], "datetime64[us]")
            yield pd.DataFrame(columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Plain lists, as frames are slow for the few rows that most surfaces have.
        seen = []
        for batch in rows:
            times = batch["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            seen += zip(times, *(batch[c].tolist() for c in ("content_hash", "secrets", "redacted_hash")))
        seen.sort(key=lambda r: r[:2])
        s, out = self._load(), []
        before = self._timers(s)
        for ts_us, content_hash, secrets, redacted_hash in seen:
            self._observe(key[0], s, ts_us, content_hash, secrets, redacted_hash, out)
        self._store(s, before)
        yield from self._frame(out)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Goes on from a row of ``state``; its open actions are due at their old times."""
        whole = {"changed_us", "secrets", "ts_us", "last_us"}
        row = initialState.astype(object).where(initialState.notna(), None).iloc[0]
        s = {f: row[f] if row[f] is None else int(row[f]) if f in whole else row[f] for f in STATE_FIELDS}
        s["redacted"], s["cleared"] = bool(s["redacted"]), bool(s["cleared"])
        self._store(s, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        before = self._timers(s)
        self._fire(key[0], s, expiredTimerInfo.getExpiryTimeInMs() * 1000, False, out)
        self._store(s, before)
        yield from self._frame(out)


def actions(
    scored: DataFrame, policy: MonitorPolicy = MonitorPolicy(), watermark: str = "10 seconds", recopy: bool = True,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Actions over a stream of scored snapshots (append mode, RocksDB state store).

    ``recopy``: the original content showing up again after an action is a new epoch. Switch it
    off where snapshots may be taken before the action has reached the surface. ``initial``: rows of ``state``, one per surface,
    from which a stream with a new checkpoint goes on.
    """
    start = initial.select("surface_id", *STATE_FIELDS).groupBy("surface_id") if initial is not None else None
    processor = SurfaceMonitor(
        policy.redact_after_s, policy.clear_after_s, policy.alerts, policy.clear_after_redact, recopy
    )
    return (
        scored.select("surface_id", "ts", "content_hash", "secrets", "redacted_hash")
        .withWatermark("ts", watermark)
        .groupBy("surface_id")
        .transformWithStateInPandas(processor, ACTIONS, outputMode="append", timeMode="EventTime", initialState=start)
    )


def state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """``surface_id`` and the state of every surface, read from the checkpoint of the ``actions`` stream, as of its last batch or of ``batch``.

    The rows come from the state store's own files, a partition a task; the stream need not run."""
    reader = spark.read.format("statestore").option("stateVarName", "surface")
    rows = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return rows.select("key.surface_id", *[F.col(f"value.{f}") for f in STATE_FIELDS])


def status_of(states: DataFrame) -> DataFrame:
    """Per surface, of the rows of ``state``: secrets now on it, last change that brought one, and whether it was redacted or cleared since
    its last change. Other than for ``status``, snapshots of the content acted upon undo nothing where the stream takes them for late copies
    (``recopy`` off)."""
    return states.select("surface_id", "secrets", F.timestamp_micros("last_us").alias("last_change"), "redacted", "cleared")


def with_content(actions: DataFrame, scored: DataFrame) -> DataFrame:
    """Add ``content_out``: the redacted text of a redact, ``''`` for a clear."""
    texts = scored.filter(F.col("redacted").isNotNull()).select(
        "surface_id", F.col("ts").alias("changed_at"), "content_hash", "redacted"
    )
    joined = actions.join(texts, ["surface_id", "changed_at", "content_hash"], "left")
    out = F.when(F.col("action") == "redact", F.col("redacted")).when(F.col("action") == "clear", "")
    return joined.withColumn("content_out", out).drop("redacted")
