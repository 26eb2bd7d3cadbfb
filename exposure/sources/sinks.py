"""Where results go: findings, scrubbed histories and registries.

A sink writes each version in a folder of its own, under a new attempt, and publishes it by a manifest row at the end.
Readers go by the manifest, so they see a version complete or not at all, empty ones included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "version string, attempt string, written timestamp"


def write_version(df: DataFrame, root: str, version: str, fmt: str = "parquet") -> str:
    """Write a version of the table below ``root``; rerunning a version replaces it once the new attempt is complete."""
    root, attempt = root.rstrip("/"), uuid.uuid4().hex
    path = f"{root}/data/{version}-{attempt}"
    df.write.format(fmt).save(path)
    spark = df.sparkSession
    row = spark.sql("SELECT :version AS version, :attempt AS attempt, current_timestamp() AS written", args={"version": version, "attempt": attempt})
    row.write.mode("append").parquet(f"{root}/manifest")
    return path


def latest_version(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """The rows of the highest complete version (by name), of its last attempt."""
    root = root.rstrip("/")
    # The manifest has a row for each version; only its last one comes back.
    newest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy("version", "written", ascending=False).first()
    if newest is None:
        raise ValueError(f"no complete version below {root}")
    return spark.read.format(fmt).load(f"{root}/data/{newest.version}-{newest.attempt}")


def write_findings(findings: DataFrame, root: str, version: str, fmt: str = "parquet") -> str:
    """Findings ordered within each file written, without any path but the masked one."""
    columns = [
        "location", "basename", "last_mod", "format", "confidence", "known_matches", "entropy_hits", "size",
    ]
    return write_version(findings.select(*columns).sortWithinPartitions("location"), root, version, fmt)


def write_scrubbed(scrubbed: DataFrame, root: str, version: str, fmt: str = "parquet") -> str:
    """The new contents of history files, one row per file, with the receipt as last line."""
    return write_version(scrubbed.select("file_id", "content"), root, version, fmt)
