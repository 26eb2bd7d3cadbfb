"""The registry of known secrets: hashes and the projects that hold them.

The long form has one row per (hash, project): ``hash, project_id, seen_at``. A project set is a
set of rows, so a secret shared by millions of projects is spread like any other rows instead of
growing into one array. ``entries`` gives the array form in pages of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.names import fallback_name
from exposure.operators.joins import join_by_hash

HEX64 = "^[0-9a-fA-F]{64}$"
# Sums of a set's state, 32 bits each.
LANES = 8
# Repeats of a row that one task writes.
RUN = 10_000
BUCKET_DIGITS = 3


def build(contributions: DataFrame) -> DataFrame:
    """Distinct (hash, project) pairs with the latest time each was seen."""
    return contributions.groupBy("hash", "project_id").agg(F.max("seen_at").alias("seen_at"))


def per_hash(pairs: DataFrame) -> DataFrame:
    """``hash, n_projects, last_seen``: one row per known secret."""
    return pairs.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_projects"), F.max("seen_at").alias("last_seen")
    )


def hashes(pairs: DataFrame) -> DataFrame:
    return pairs.select("hash").distinct()


def entries(pairs: DataFrame, page_size: int = 1000) -> DataFrame:
    """``hash, page, projects, n_projects, last_seen``: sorted project sets as arrays.

    A hash with up to ``page_size`` projects has the one page 0. A larger set is divided over
    pages by a hash of the project, so no task gathers it whole.
    """
    totals = per_hash(pairs)
    sized = join_by_hash(pairs, totals, ["project_id"], "inner")
    pages = F.ceil(F.col("n_projects") / page_size)
    return (
        sized.withColumn("page", F.pmod(F.xxhash64("project_id"), pages).cast("int"))
        .groupBy("hash", "page")
        .agg(
            F.array_sort(F.collect_list("project_id")).alias("projects"),
            F.first("n_projects").alias("n_projects"),
            F.first("last_seen").alias("last_seen"),
        )
    )


def snapshot(pairs: DataFrame, scan_state: str = "completed") -> DataFrame:
    """One row: tracked hashes, hashes in several projects, scan state."""
    return per_hash(pairs).agg(
        F.count(F.lit(1)).alias("tracked_hashes"),
        F.count_if(F.col("n_projects") > 1).alias("duplicate_hashes"),
        F.lit(scan_state).alias("scan_state"),
    )


def approximate_size(pairs: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Tracked hashes for a dashboard, without the exact distinct."""
    return pairs.agg(F.approx_count_distinct("hash", rsd).alias("tracked_hashes"))


def with_display_names(pairs: DataFrame, project_meta: DataFrame) -> DataFrame:
    """Add ``display_name``, falling back to a short form of the id. Large projects are spread."""
    meta = project_meta.select("project_id", "display_name")
    named = join_by_hash(pairs, meta, ["hash"], "left", key="project_id")
    name = F.coalesce(F.nullif(F.col("display_name"), F.lit("")), fallback_name(F.col("project_id")))
    return named.withColumn("display_name", name)


def duplicates(pairs: DataFrame) -> DataFrame:
    """``hash, project_id, n_projects`` of secrets held by more than one project."""
    shared = per_hash(pairs).filter(F.col("n_projects") > 1).select("hash", "n_projects")
    return join_by_hash(pairs.select("hash", "project_id"), shared, ["project_id"], "inner")


def projects_of(wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """``hash, project_id`` for the wanted hashes that are known."""
    asked = wanted.select("hash").distinct()
    return join_by_hash(pairs.select("hash", "project_id"), asked, ["project_id"], "left_semi")


def check_hex(asked: DataFrame, pairs: DataFrame, column: str = "hash_hex") -> DataFrame:
    """Add ``known``; anything but 64 hex digits is unknown.

    Repeats of a row are counted before anything moves, looked up once and repeated again after the
    lookup, so a hash asked for a million times is one row in the join.
    """
    columns = asked.columns
    asked = asked.groupBy(*columns).agg(F.count(F.lit(1)).alias("_repeats"))
    valid = F.when(F.col(column).rlike(HEX64), F.lower(F.col(column)))
    distinct = asked.select(valid.alias("hash")).filter(F.col("hash").isNotNull()).distinct()
    hits = distinct.join(pairs.select("hash"), "hash", "left_semi").withColumn("_hit", F.lit(True))
    keyed = asked.withColumn("hash", valid)
    answered = join_by_hash(keyed, hits, columns).select(*columns, "_repeats", F.coalesce(F.col("_hit"), F.lit(False)).alias("known"))
    # Runs of bounded length, dealt out before they are repeated: a row asked for very often is written by many tasks.
    many, run = F.col("_repeats") > RUN, F.lit(RUN)
    runs = answered.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_repeats") - 1) / run))))
    place = F.when(many, F.pmod(F.xxhash64("_run", *columns), F.lit(1 << 20)))
    runs = runs.withColumn("_place", F.coalesce(place, F.xxhash64(*columns))).repartition("_place")
    length = F.least(run, F.col("_repeats") - F.col("_run") * run)
    return runs.withColumn("_repeat", F.explode(F.sequence(F.lit(1).cast("long"), length))).select(*columns, "known")


def remove_pairs(pairs: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop (hash, project) pairs; a hash without projects disappears with its last row."""
    return pairs.join(removed.select("hash", "project_id"), ["hash", "project_id"], "left_anti")


def clear_project(pairs: DataFrame, project_id) -> DataFrame:
    """Drop everything one project or source contributed."""
    return pairs.filter(F.col("project_id") != project_id)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``change, hash``: hashes added and removed between two registries."""
    old, new = hashes(before), hashes(after)
    added = new.join(old, "hash", "left_anti").select(F.lit("added").alias("change"), "hash")
    removed = old.join(new, "hash", "left_anti").select(F.lit("removed").alias("change"), "hash")
    return added.unionByName(removed)


def fingerprint(pairs: DataFrame) -> DataFrame:
    """One row ``regfp``: an id of the set of known hashes, independent of order and grouping.

    Hashes are bucketed by their first digits (uniform, as they are SHA-256), each bucket is
    fingerprinted on its own and the 4096 bucket fingerprints are fingerprinted again. ``'0'``
    for an empty registry.
    """
    buckets = (
        hashes(pairs)
        .groupBy(F.left(F.col("hash"), F.lit(BUCKET_DIGITS)).alias("bucket"))
        .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("fp"))
    )
    return _combine(buckets, F.concat("bucket", "fp"))


def _combine(df: DataFrame, part) -> DataFrame:
    joined = F.array_join(F.array_sort(F.collect_list(part)), "")
    value = F.when(F.count(F.lit(1)) == 0, "0").otherwise(F.left(F.sha2(joined, 256), F.lit(16)))
    return df.agg(value.alias("regfp"))


# --- a fingerprint that follows changes ---------------------------------------------------------


def set_state(pairs: DataFrame) -> DataFrame:
    """One row ``n, lanes``: the number of known hashes, and ``LANES`` sums of 32-bit pieces of their digests modulo 2^32.

    Sums don't depend on order and unite by partial aggregation; no task holds more than one row of them. The state of a set follows from that of another one
    and what was added and removed (``updated_state``). Two sets of equal states are different by chance with a probability of about 2^-256; it is
    no protection against sets made to collide.
    """
    return _state(hashes(pairs), F.lit(1))


def _state(rows: DataFrame, sign: Column) -> DataFrame:
    """Sums of distinct hashes, each with the weight ``sign``."""
    digest = F.sha2(F.concat(F.lit("set:"), F.col("hash")), 256)
    pieces = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") * sign for i in range(LANES)]
    sums = [F.pmod(F.coalesce(F.sum(p), F.lit(0)), F.lit(1 << 32).cast("decimal(20,0)")).cast("long") for p in pieces]
    return rows.agg(F.coalesce(F.sum(sign.cast("long")), F.lit(0)).alias("n"), F.array(*sums).alias("lanes"))


def updated_state(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The state after ``changes`` (``change, hash``), without reading the registry again."""
    sign = F.when(F.col("change") == "added", 1).otherwise(-1)
    both = state.select("n", "lanes").unionByName(_state(changed, sign))
    lanes = [F.pmod(F.sum(F.col("lanes")[i]), F.lit(1 << 32)) for i in range(LANES)]
    return both.agg(F.sum("n").alias("n"), F.array(*lanes).alias("lanes"))


def state_fingerprint(state: DataFrame) -> DataFrame:
    """One row ``regfp`` of a state; ``'0'`` for an empty registry."""
    text = F.array_join(F.concat(F.array(F.col("n").cast("string")), F.transform("lanes", lambda x: x.cast("string"))), ":")
    return state.select(F.when(F.col("n") == 0, "0").otherwise(F.left(F.sha2(text, 256), F.lit(16))).alias("regfp"))
