"""Rescan end to end: every source collected anew, one row set of what it gave, with errors and scan state.

Errors are results, not exceptions. A source whose settings are missing or whose listing is broken as a whole fails: it contributes nothing, and
the others still count. What could not be read within a source (a file, a folder) is an error beside its contributions. A source that is
switched off contributes nothing and has no row, so what it gave to the old registry is gone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.operators import registry as R
from exposure.params import PathPolicy
from exposure.plans import discovery

COMPLETED, FAILED = "completed", "failed"


@dataclass
class Source:
    """``contributions``: ``hash, project_id, seen_at``. ``errors``: ``error``, what could not be read. ``failure``: why the source can't be collected at all."""

    name: str
    contributions: DataFrame | None = None
    errors: DataFrame | None = None
    failure: str | None = None
    enabled: bool = True


def env_source(corpus: DataFrame, policy: PathPolicy, rules: DataFrame | None = None, attribution: str = "source") -> Source:
    """The env files of a corpus as a source (``discovery``), with what the listing could not read below the roots."""
    if policy.roots_enabled and not policy.roots:
        return Source("env", failure="no roots configured")
    read = corpus.filter(F.col("error").isNull()) if "error" in corpus.columns else corpus
    found = discovery.pairs(discovery.env_files(read, policy, rules), attribution)
    return Source("env", found, discovery.errors(corpus, policy).select("error"), enabled=policy.roots_enabled)


def collected(sources: Iterable[Source]) -> DataFrame | None:
    """``hash, project_id, seen_at, source`` of all sources that can be collected: the new registry's input."""
    good = [s.contributions.select("hash", "project_id", "seen_at", F.lit(s.name).alias("source")) for s in sources if s.enabled and not s.failure and s.contributions is not None]
    return reduce(DataFrame.unionByName, good) if good else None


def errors(sources: Iterable[Source]) -> DataFrame | None:
    """``source, error`` of all enabled sources, failures included."""
    out = []
    for s in (s for s in sources if s.enabled):
        if s.failure:
            some = s.contributions if s.contributions is not None else s.errors
            if some is not None:
                out.append(some.sparkSession.sql("SELECT :n AS source, :e AS error", args={"n": s.name, "e": s.failure}))
        elif s.errors is not None:
            out.append(s.errors.select(F.lit(s.name).alias("source"), "error"))
    return reduce(DataFrame.unionByName, out) if out else None


def report(before: DataFrame, sources: Iterable[Source]) -> DataFrame:
    """One row set of a rescan: ``stage, source, before, after, hashes, added, removed, error, state``.

    ``registry``: hashes before and after, added and removed, and the scan state, ``failed`` where any source had an error. ``collect``: what
    each source contributed, repeats included, 0 too. ``errors``: each message of a source with the number of times it came up.

    Old and new hashes go through one aggregation by hash, so every source is read once.
    """
    sources = [s for s in sources if s.enabled]
    spark = before.sparkSession
    live = [s for s in sources if not s.failure]
    found = collected(live)
    old = before.select("hash", F.lit(None).cast("string").alias("source"))
    rows = old if found is None else old.unionByName(found.select("hash", "source"))
    from_ = F.col("source")
    per_hash = rows.groupBy("hash").agg(
        F.bool_or(from_.isNull()).alias("was"),
        F.bool_or(from_.isNotNull()).alias("is"),
        *[F.count_if(from_ == s.name).alias(f"n{i}") for i, s in enumerate(live)],
    ).filter(F.col("hash").isNotNull())
    totals = per_hash.agg(
        F.count_if("was").alias("before"), F.count_if("is").alias("after"),
        F.count_if(F.col("is") & ~F.col("was")).alias("added"), F.count_if(F.col("was") & ~F.col("is")).alias("removed"),
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(live))],
    )
    text, none = F.lit(None).cast("string"), F.lit(None).cast("long")

    def row(stage: str, **cells: Column) -> Column:
        names = {"source": text, "before": none, "after": none, "hashes": none, "added": none, "removed": none, "error": text, "state": text}
        return F.struct(F.lit(stage).alias("stage"), *[cells.get(k, v).alias(k) for k, v in names.items()])

    bad = errors(sources)
    for s in sources:
        # A failed source without any table to start from.
        if s.failure and s.contributions is None and s.errors is None:
            one = spark.sql("SELECT :n AS source, :e AS error", args={"n": s.name, "e": s.failure})
            bad = one if bad is None else bad.unionByName(one)
    if bad is None:
        bad = spark.sql("SELECT '' AS source, '' AS error").limit(0)
    counted = bad.groupBy("source", "error").agg(F.count(F.lit(1)).alias("hashes"))
    # A sum of the counts, not a count of the rows: with the same columns the messages' aggregation is reused.
    states = counted.agg(F.when(F.sum("hashes") > 0, FAILED).otherwise(COMPLETED).alias("state"))
    facts = F.array(
        row("registry", **{c: F.col(c) for c in ("before", "after", "added", "removed")}),
        *[row("collect", source=F.lit(s.name), hashes=F.col(f"n{i}")) for i, s in enumerate(live)],
    )
    counts = totals.select(F.inline(facts))
    state = states.select(F.inline(F.array(row("state", state=F.col("state")))))
    messages = counted.select(F.inline(F.array(row("errors", source=F.col("source"), hashes=F.col("hashes"), error=F.col("error")))))
    return counts.unionByName(state).unionByName(messages)


def rescan(sources: Iterable[Source]) -> DataFrame | None:
    """The new registry in long form, None where no source could be collected."""
    found = collected(sources)
    return None if found is None else R.build(found)
