"""History scrub end to end: targets, decision per file, scrub, new version, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.operators import history, policy, registry
from exposure.params import PLACEHOLDER, Gate


def scrub(
    corpus: DataFrame,
    pairs: DataFrame,
    roots,
    extras=(),
    history_file: str | None = None,
    mode: str = "delete",
    placeholder: str = PLACEHOLDER,
    full: bool = False,
    gate: Gate = Gate(),
) -> DataFrame:
    """Scrub the history files of a corpus; see ``history.scrub_files`` for the columns.

    The targets are a filter on the path, so contents are read for these files only and stay
    where they are.
    """
    targets = corpus.filter(policy.is_history_target(F.col("path"), roots, extras, history_file))
    files = targets.select(F.col("path").alias("file_id"), F.col("content").cast("string").alias("content"))
    regfp = registry.fingerprint(pairs).scalar()
    return history.scrub_files(files, registry.hashes(pairs), regfp, mode, placeholder, full, gate)


def report(scrubbed: DataFrame) -> DataFrame:
    """One row: files, changed files, deleted, redacted, secrets, skipped."""
    return scrubbed.agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(F.col("deleted") + F.col("redacted") > 0).alias("changed_files"),
        F.sum("deleted").alias("deleted"),
        F.sum("redacted").alias("redacted"),
        F.sum("secrets").alias("secrets"),
        F.count_if("skipped").alias("skipped"),
    )


def preview(scrubbed: DataFrame) -> DataFrame:
    """What a scrub would do, per file with changes; examples hold placeholders only."""
    changed = scrubbed.filter(F.col("deleted") + F.col("redacted") > 0)
    return changed.select(
        "file_id",
        F.col("deleted").alias("would_delete"),
        F.col("redacted").alias("would_redact"),
        F.col("secrets").alias("secrets_found"),
        "examples",
    )
