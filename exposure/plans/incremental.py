"""Jobs on what changed since last time, by manifests instead of times.

A state folder holds a versioned manifest, a row ``path, size, modified, basis, version`` for each file, and the results of each version. A step
compares a new listing with the last manifest: rows that it doesn't hold are worked on, whatever their time, so a file that is moved in with an old
time counts as new, and one that got another size or an older time as changed. The results of the step are written first and the manifest last; a step that fails in
between leaves the old state, and its next try replaces the version. ``current`` gives the results of each file's last version; those of files
that are gone are left out. ``basis`` names what results depend on beside the file, such as the fingerprint of the registry and of the
rules: where it changes, everything is worked on again.

Only narrow rows are compared; the files left to work on are a listing, whose contents are read by the step's own work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.operators.history import scrub_files
from exposure.params import Gate, PathPolicy
from exposure.plans.residue_scan import scan, scan_listing
from exposure.sources import sinks

MANIFEST = "path string, size long, modified timestamp, basis string, version long"
KEY = ("path", "size", "modified", "basis")


def _last(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version of a sink, or None before the first one."""
    try:
        spark.read.schema(sinks.MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return None
    return sinks.latest_version(spark, root)


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` with ``version`` of the same file in ``right``; unknown sizes and times equal each other."""
    old = right.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("version").alias("_version"))
    same = F.col("path") == F.col("_path")
    for c in KEY[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(old, same, "left").select(*left.columns, "_version")


def step(listing: DataFrame, state: str, work: Callable[[DataFrame], DataFrame], basis: str = "") -> int:
    """Work on the files of ``listing (path, size, modified, ...)`` that are new or changed; the number of the version.

    ``work`` takes these rows and returns results with a column ``path``. The listing is read twice: pass a stored one."""
    spark = listing.sparkSession
    before = _last(spark, f"{state}/manifest")
    placed = listing.withColumn("basis", F.lit(basis))
    if before is None:
        version, known = 1, placed.withColumn("_version", F.lit(None).cast("long"))
    else:
        version = 1 + (before.agg(F.max("version")).first()[0] or 0)
        # An empty step has a version too, which no file of the manifest may show.
        version = max(version, 1 + _steps(spark, state))
        known = _same(placed, before)
    changed = known.filter(F.col("_version").isNull()).select(*listing.columns)
    sinks.write_version(work(changed), f"{state}/results", f"{version:012d}")
    after = known.select(*KEY, F.coalesce("_version", F.lit(version).cast("long")).alias("version")).distinct()
    sinks.write_version(after, f"{state}/manifest", f"{version:012d}")
    return version


def _steps(spark: SparkSession, state: str) -> int:
    """The number of the last complete step."""
    newest = spark.read.schema(sinks.MANIFEST).parquet(f"{state}/manifest/manifest").agg(F.max("version")).first()[0]
    return int(newest or 0)


def current(spark: SparkSession, state: str) -> DataFrame:
    """The results of every file of the last manifest, each of the version that worked on it last. Rows without a path belong to the last version."""
    manifest = _last(spark, f"{state}/manifest")
    if manifest is None:
        raise ValueError(f"no complete step below {state}")
    last = _steps(spark, state)
    # One row for each step, so few.
    attempts = spark.read.schema(sinks.MANIFEST).parquet(f"{state}/results/manifest").filter(F.col("version").cast("long") <= last)
    newest = attempts.groupBy("version").agg(F.max_by("attempt", "written").alias("attempt")).orderBy("version").collect()
    out = None
    for r in newest:
        rows = spark.read.parquet(f"{state}/results/data/{r.version}-{r.attempt}").withColumn("_version", F.lit(int(r.version)).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    live = manifest.select(F.col("path").alias("_path"), F.col("version").alias("_of"))
    mine = (F.col("path") == F.col("_path")) & (F.col("_version") == F.col("_of"))
    pathless = out.filter(F.col("path").isNull() & (F.col("_version") == last))
    return out.join(live, mine, "left_semi").unionByName(pathless).drop("_version")


def compact(spark: SparkSession, state: str, into: str) -> None:
    """A new state folder with the current results as its only version, so that reading does not slow down with the number of steps."""
    sinks.write_version(current(spark, state), f"{into}/results", f"{1:012d}")
    manifest = _last(spark, f"{state}/manifest").withColumn("version", F.lit(1).cast("long"))
    sinks.write_version(manifest, f"{into}/manifest", f"{1:012d}")


def residue_step(
    listing: DataFrame, state: str, registry: DataFrame, policy: PathPolicy, rules: DataFrame | None = None,
    home: str = "", gate: Gate = Gate(), basis: str = "", contents: DataFrame | None = None, max_bytes: int = 1 << 30,
) -> int:
    """Scan the new and changed files of a listing. ``contents (path, content)`` is a table that holds the files; without it they are read from where they
    are listed, the ones that paths let through."""

    def work(changed: DataFrame) -> DataFrame:
        if contents is None:
            return scan_listing(changed, registry, policy, rules, home, gate, max_bytes=max_bytes)
        return scan(contents.join(changed.select("path"), "path", "left_semi"), registry, policy, rules, home, gate)

    return step(listing, state, work, basis)


def history_step(
    listing: DataFrame, state: str, registry: DataFrame, regfp: str, contents: DataFrame, mode: str = "delete", gate: Gate = Gate(),
) -> int:
    """Scrub the new and changed history files of a listing; ``contents`` has ``path, content``. A changed registry works on all of them again."""

    def work(changed: DataFrame) -> DataFrame:
        files = contents.join(changed.select("path"), "path", "left_semi").select(F.col("path").alias("file_id"), "content")
        return scrub_files(files, registry, F.lit(regfp), mode, gate=gate).withColumnRenamed("file_id", "path")

    return step(listing, state, work, regfp)
