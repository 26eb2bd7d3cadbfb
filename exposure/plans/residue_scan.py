"""Residue scan end to end: corpus, path policy, ignore rules, detection, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.operators import policy as P
from exposure.operators import residue
from exposure.functions.names import basename, dirname
from exposure.params import IGNORE_FILES, Gate, PathPolicy, merge_surfaces
from exposure.sources import sinks, walk


def with_surface(files: DataFrame, policy: PathPolicy) -> DataFrame:
    """Each file once per surface directory it is below, with its relative path."""
    path = F.col("path")
    hits = [
        F.when(
            P.relative_to(path, s.path).isNotNull() & ~P.in_skipped_dir(path, s.path, policy.skip_dirs),
            F.struct(
                F.lit(i).alias("surface_no"), F.lit(s.path).alias("root"), P.relative_to(path, s.path).alias("rel")
            ),
        )
        for i, s in enumerate(merge_surfaces(policy.surfaces))
    ]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return files.withColumn("_s", F.explode_outer(found)).filter(F.col("_s").isNotNull()).select(
        *files.columns, "_s.surface_no", "_s.root", "_s.rel"
    )


def ignore_rule_files(corpus: DataFrame, policy: PathPolicy, names=IGNORE_FILES) -> DataFrame:
    """``root, file_no, content`` of the ignore files at the root of each surface."""
    roots = [s.path for s in merge_surfaces(policy.surfaces)]
    path = F.col("path")
    number = reduce(
        lambda acc, p: acc.when(basename(path) == p[1], p[0]), enumerate(names), F.when(F.lit(False), -1)
    )
    return corpus.filter(basename(path).isin(list(names)) & dirname(path).isin(roots)).select(
        dirname(path).alias("root"), number.alias("file_no"), F.col("content").cast("string").alias("content")
    )


def examined(corpus: DataFrame, policy: PathPolicy, rules: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """The files to look into, per surface: not skipped, not ignored, not claimed, on a surface.

    Only path columns decide, so a columnar source reads contents for the surviving files alone.
    A file below two nested surfaces is examined for each, unless ``dedupe`` is set.
    """
    placed = with_surface(corpus, policy)
    if rules is not None:
        placed = P.without_ignored(placed, rules, ["surface_no", "path"])
    treated = P.classify(placed, policy).filter("treat").drop("treat", "reason")
    if dedupe:
        treated = treated.dropDuplicates(["path"])
    return treated


def scan(
    corpus: DataFrame,
    registry: DataFrame,
    policy: PathPolicy,
    rules: DataFrame | None = None,
    home: str = "",
    gate: Gate = Gate(),
    dedupe: bool = False,
    known_always: bool = False,
) -> DataFrame:
    """Findings of a corpus ``path, modified, size, content``."""
    files = examined(corpus, policy, rules, dedupe)
    return residue.findings(
        files, registry, home, gate, id_cols=("surface_no", "path"), known_always=known_always
    )


def scan_listing(
    listing: DataFrame,
    registry: DataFrame,
    policy: PathPolicy,
    rules: DataFrame | None = None,
    home: str = "",
    gate: Gate = Gate(),
    dedupe: bool = False,
    known_always: bool = False,
    max_bytes: int = 1 << 30,
) -> DataFrame:
    """Findings of a stored listing (``walk.listing``), and what could not be listed or read as rows with ``error``.

    Roots, surfaces and ignore rules decide on paths; only the files left are opened, in parts of ``max_bytes``. Store the result before it is read more than
    once: it reads the files."""
    bad = listing.filter(F.col("error").isNotNull()).withColumns({"surface_no": F.lit(None).cast("int")})
    placed = examined(listing.filter(F.col("error").isNull()), policy, rules, dedupe)
    wanted = placed.select("surface_no", "path", "modified", "size", "error").unionByName(bad.select("surface_no", "path", "modified", "size", "error"))
    return residue.findings_of_parts(
        walk.contents(wanted, max_bytes), registry, home, gate, id_cols=("surface_no", "path"), known_always=known_always
    )


def scanned_directories(corpus: DataFrame, policy: PathPolicy, rules: DataFrame | None = None) -> DataFrame:
    """``surface_no, directory`` of every directory walked: the ones that hold files and all
    between them and their surface, without skipped and ignored ones."""
    own = corpus.select(dirname(F.col("path")).alias("path")).distinct()
    above = own.select(F.explode(P.path_prefixes(F.concat("path", F.lit("/")))).alias("path")).distinct()
    placed = with_surface(above.withColumn("path", F.concat("path", F.lit("/"))), policy)
    dirs = placed.withColumn("rel", F.when(F.col("rel") == "", ".").otherwise(F.regexp_replace("rel", "/$", "")))
    if rules is not None:
        dirs = P.mark_ignored(dirs.withColumn("is_dir", F.lit(True)), rules).filter(~F.col("ignored"))
    return dirs.select("surface_no", F.regexp_replace("path", "/$", "").alias("directory"))


def summary(found: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """One row: findings, files examined, directories scanned, first three locations.

    Reads ``found`` twice; pass the stored findings rather than the plan that computes them.
    """
    none = F.lit(None).cast("long")

    def column(df: DataFrame, name: str) -> DataFrame:
        cells: dict[str, Column] = {c: none for c in ("examined", "scanned")}
        cells[name] = F.col("n")
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            none.alias("findings"),
            F.lit(None).cast("array<string>").alias("sample"),
            *[c.alias(k) for k, c in cells.items()],
        )

    base = residue.summary(found, ["surface_no", "path"]).select(
        "findings", "sample", none.alias("examined"), none.alias("scanned")
    )
    parts = base.unionByName(column(files, "examined")).unionByName(column(directories, "scanned"))
    return parts.agg(
        F.max("findings").alias("findings"),
        F.max("examined").alias("examined"),
        F.max("scanned").alias("scanned"),
        F.first("sample", True).alias("sample"),
    )


def stored_summary(found: DataFrame, paths: DataFrame, policy: PathPolicy, root: str, version: str, rules: DataFrame | None = None) -> DataFrame:
    """Write the findings of a scan as a version below ``root``, and sum them up from there.

    The scan runs once, while its findings are written. Files and directories are counted from ``paths``, which needs the column ``path`` alone: a listing, or the path
    column of the corpus. No text is read for them.
    """
    sinks.write_version(found, root, version)
    stored = sinks.latest_version(found.sparkSession, root)
    if "error" in stored.columns:
        stored = stored.filter(F.col("error").isNull())
    return summary(stored, examined(paths, policy, rules), scanned_directories(paths, policy, rules))
