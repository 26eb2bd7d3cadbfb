"""Environment files as a source of secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.globs import key_ignored
from exposure.functions.names import dirname, logical_id, opaque_id
from exposure.functions.text import sha256_hex, trim_space
from exposure.params import KEY_IGNORE_PATTERNS

# Lines from here on are reported; they are read like any other.
MAX_LINE_BYTES = 64 * 1024


def _short_lines(content: Column) -> Column:
    """No line reaches 64 KiB."""
    longest = F.array_max(F.transform(F.split(content, "\n"), lambda x: F.octet_length(x)))
    return F.when(F.octet_length(content) < MAX_LINE_BYTES, True).otherwise(longest < MAX_LINE_BYTES)


def env_pairs(files: DataFrame, carry: list[str], content: str = "content", ignore=KEY_IGNORE_PATTERNS) -> DataFrame:
    """``carry, line_no, key, hash`` of every assignment that may be a secret.

    The value is hashed in the projection that cuts it out of its line; it is not an output.
    """
    lines = files.select(*carry, F.posexplode(F.split(F.col(content), "\n")).alias("line_no", "raw"))
    line = trim_space(F.col("raw"))
    assigned = lines.filter(F.contains("raw", F.lit("=")) & ~line.startswith("#"))
    key = trim_space(F.substring_index(line, "=", 1))
    value = F.btrim(trim_space(F.regexp_replace(line, "(?s)^[^=]*=", "")), F.lit("\"'"))
    return (
        assigned.select(*carry, "line_no", key.alias("key"), value.alias("_value"))
        .filter((F.col("_value") != "") & ~key_ignored(F.col("key"), ignore))
        .select(*carry, "line_no", "key", sha256_hex(F.col("_value")).alias("hash"))
    )


def contributions(
    files: DataFrame, attribution: str = "directory", ignore=KEY_IGNORE_PATTERNS, source: str = "env"
) -> DataFrame:
    """``hash, project_id, seen_at, source`` from ``path, modified, content``.

    ``attribution='directory'`` takes each file's directory as the project (first discovery);
    ``'source'`` takes the source as a whole (rescan).
    """
    pairs = env_pairs(files, ["path", "modified"], ignore=ignore)
    project = opaque_id(dirname(F.col("path"))) if attribution == "directory" else logical_id(F.lit(source))
    return pairs.select(
        "hash", project.alias("project_id"), F.col("modified").alias("seen_at"), F.lit(source).alias("source")
    )


def long_lines(files: DataFrame) -> DataFrame:
    """Files with a line of 64 KiB or more, as a report."""
    return files.filter(~_short_lines(F.col("content"))).select(
        F.concat(F.lit("long line: "), opaque_id(F.col("path"))).alias("error")
    )
