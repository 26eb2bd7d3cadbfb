"""First discovery: a corpus of files to the secrets of its env files, their projects, the state of the scan and its errors.

Roots, skipped directories, name patterns and ignore rules look at paths alone; of the corpus only files named like env files
go on to the rules, and only those left are read into pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.functions.globs import matches_any_glob
from exposure.functions.names import basename, dirname, display_name, opaque_id
from exposure.operators import policy as P
from exposure.params import IGNORE_FILES, PathPolicy
from exposure.sources import envfile


def root_rule_files(corpus: DataFrame, roots, names=IGNORE_FILES) -> DataFrame:
    """``root, file_no, content`` of the ignore files directly in a root."""
    path = F.col("path")
    number = reduce(lambda acc, p: acc.when(basename(path) == p[1], p[0]), enumerate(names), F.when(F.lit(False), -1))
    return corpus.filter(basename(path).isin(list(names)) & dirname(path).isin([r.rstrip("/") or "/" for r in roots])).select(
        dirname(path).alias("root"), number.alias("file_no"), F.col("content").cast("string").alias("content")
    )


def env_files(corpus: DataFrame, policy: PathPolicy, rules: DataFrame | None = None) -> DataFrame:
    """The env files below the roots: not below a skipped directory, not ignored, named like one. A file below two nested roots
    counts for both, and is kept if either keeps it."""
    path = F.col("path")
    if not policy.roots_enabled or not policy.roots:
        return corpus.filter(F.lit(False))
    named = corpus.filter(matches_any_glob(basename(path), policy.root_patterns or (".env*",)))
    hits = [
        F.when(
            P.relative_to(path, r).isNotNull() & ~P.in_skipped_dir(path, r, policy.skip_dirs),
            F.struct(F.lit(r.rstrip("/") or "/").alias("root"), P.relative_to(path, r).alias("rel")),
        )
        for r in dict.fromkeys(policy.roots)
    ]
    placed = named.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_at")).select(*corpus.columns, "_at.*")
    if rules is not None:
        placed = P.without_ignored(placed, rules, ["root", "path"])
    return placed.select(*corpus.columns, "root")


def pairs(files: DataFrame, attribution: str = "directory") -> DataFrame:
    """``hash, project_id, seen_at, source`` of env files."""
    return envfile.contributions(files, attribution)


def projects(files: DataFrame) -> DataFrame:
    """``project_id, display_name`` of the directories that hold env files, with or without a secret in them."""
    directory = dirname(F.col("path"))
    return files.select(opaque_id(directory).alias("project_id"), display_name(directory).alias("display_name")).distinct()


def errors(corpus: DataFrame, policy: PathPolicy) -> DataFrame:
    """``source, error``: missing settings, and what the corpus source could not list or read below the roots."""
    if not policy.roots_enabled:
        return corpus.select(F.lit("env").alias("source"), F.lit("").alias("error")).filter(F.lit(False))
    if not policy.roots:
        spark = corpus.sparkSession
        return spark.sql("SELECT 'env' AS source, 'no roots configured' AS error")
    if "error" not in corpus.columns:
        return corpus.select(F.lit("env").alias("source"), F.lit("").alias("error")).filter(F.lit(False))
    below = reduce(lambda a, b: a | b, [P.relative_to(F.col("path"), r).isNotNull() for r in policy.roots])
    return corpus.filter(below & F.col("error").isNotNull()).select(F.lit("env").alias("source"), "error")


def state(found: DataFrame) -> DataFrame:
    """One row ``state, errors``: ``failed`` where there was an error; what was found elsewhere still counts."""
    n = F.count(F.lit(1))
    return found.agg(F.when(n > 0, "failed").otherwise("completed").alias("state"), n.alias("errors"))
