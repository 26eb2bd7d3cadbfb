"""Rescan: collect every source anew, replace the registry and report what changed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.operators import registry as R


def collect_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the contributions of all sources (``hash, project_id, seen_at, source``)."""
    out: DataFrame | None = None
    for name, df in sources.items():
        part = df.select("hash", "project_id", "seen_at", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least one source is needed")
    return out


def contribution_counts(contributions: DataFrame) -> DataFrame:
    """``source, hashes``: hashes contributed per source, repeats included."""
    return contributions.groupBy("source").agg(F.count(F.lit(1)).alias("hashes"))


def rescan(sources: Mapping[str, DataFrame]) -> DataFrame:
    """The new registry in long form. It replaces the old one, so what a disabled or deleted
    source contributed is gone."""
    return R.build(collect_sources(sources))


def delta(before: DataFrame, contributions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Metrics rows ``stage, source, before, after, hashes, errors``: one for the registry and
    one per source."""
    none = F.lit(None).cast("long")
    old = R.hashes(before).agg(F.count(F.lit(1)).alias("before"))
    new = R.hashes(contributions).agg(F.count(F.lit(1)).alias("after"))
    total = (
        old.withColumn("after", none)
        .unionByName(new.withColumn("before", none))
        .agg(F.max("before").alias("before"), F.max("after").alias("after"))
        .select(F.lit("registry").alias("stage"), F.lit(None).cast("string").alias("source"), "before", "after",
                none.alias("hashes"), F.lit(None).cast("array<string>").alias("errors"))
    )
    per_source = contribution_counts(contributions).select(
        F.lit("collect").alias("stage"), "source", none.alias("before"), none.alias("after"), "hashes",
        F.lit(None).cast("array<string>").alias("errors"),
    )
    out = total.unionByName(per_source)
    if errors is not None:
        # repeated messages are counted before they are listed, so the list stays short
        counted = errors.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
        rows = counted.select(
            F.lit("errors").alias("stage"), F.lit(None).cast("string").alias("source"), none.alias("before"),
            none.alias("after"), F.col("n").alias("hashes"), F.array("error").alias("errors"),
        )
        out = out.unionByName(rows)
    return out
