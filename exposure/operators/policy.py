"""Which files belong where: roots, surfaces, skipped directories and ignore rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.globs import (
    any_of,
    compile_rule,
    glob_matches,
    is_history_file,
    matches_any_glob,
    parse_ignore_line,
    rule_applies,
)
from exposure.functions.names import basename, dirname
from exposure.functions.text import trim_space
from exposure.operators.joins import join_by_hash, small_enough
from exposure.params import PathPolicy, Surface

PREFIX_SALTS = 64
BROAD_PATTERNS = ("", "*", "**", "**/*")
CLAIMED_REASON = "claimed by a root"
OUTSIDE_REASON = "outside every surface"


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root`` (``.`` for the root itself), NULL when it is not below it."""
    base = root.rstrip("/")
    rel = path.substr(F.lit(len(base) + 2), F.char_length(path))
    below = path.startswith(base + "/") & ~rel.startswith("..")
    return F.when(path == (base or "/"), ".").when(below, rel)


def in_skipped_dir(path: Column, root: str, skip_dirs) -> Column:
    """Some directory from the root's own name down to the file's has a skipped name."""
    rel = relative_to(path, root)
    own = root.rstrip("/").rsplit("/", 1)[-1]
    parts = F.split(F.concat(F.lit(own + "/"), rel), "/")
    names = F.array(*[F.lit(d) for d in skip_dirs]) if skip_dirs else F.array().cast("array<string>")
    return F.coalesce(F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), names), F.lit(False))


def is_claimed(path: Column, policy: PathPolicy) -> Column:
    """The file is under a root and named like a place where secrets belong."""
    if not policy.roots_enabled:
        return F.lit(False)
    under = any_of(relative_to(path, r).isNotNull() for r in policy.roots)
    return under & matches_any_glob(basename(path), policy.root_patterns or (".env*",))


def is_broad(files) -> bool:
    return not files or any(f.strip() in BROAD_PATTERNS for f in files)


def on_surface(path: Column, surface: Surface) -> Column:
    rel = relative_to(path, surface.path)
    if is_broad(surface.files):
        return rel.isNotNull()
    named = matches_any_glob(basename(path), surface.files) | matches_any_glob(rel, surface.files)
    return rel.isNotNull() & F.coalesce(named, F.lit(False))


def surface_reason(path: Column, policy: PathPolicy) -> Column:
    """``under <surface>`` for the first surface the file is on, else NULL."""
    return F.coalesce(
        *[F.when(on_surface(path, s), f"under {s.path}") for s in policy.surfaces], F.lit(None).cast("string")
    )


def classify(df: DataFrame, policy: PathPolicy, path: str = "path") -> DataFrame:
    """Add ``treat`` and ``reason``: a claimed file is never residue, any other needs a surface."""
    p = F.col(path)
    reason = F.when(is_claimed(p, policy), CLAIMED_REASON).otherwise(
        F.coalesce(surface_reason(p, policy), F.lit(OUTSIDE_REASON))
    )
    return df.withColumn("reason", reason).withColumn("treat", F.col("reason").startswith("under "))


def path_prefixes(path: Column) -> Column:
    """Every ancestor directory of a path, ``/`` included."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.when(i == 1, "/").otherwise(F.array_join(F.slice(parts, 1, i), "/")),
    )


def join_on_prefix(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Each path with every row of a root table whose ``root`` is one of its ancestors.

    An equi join on the ancestors replaces comparing every path with every root. High ancestors
    are shared by nearly all paths, hence the wide spread.
    """
    exploded = paths.withColumn("root", F.explode(path_prefixes(F.col(path))))
    return join_by_hash(exploded, roots, [path], "inner", key="root", salts=PREFIX_SALTS)


def claimed_by_table(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``path`` of files claimed by a root table ``root, pattern`` (many roots)."""
    joined = join_on_prefix(paths.select(path), roots, path)
    return joined.filter(glob_matches(basename(F.col(path)), F.col("pattern"))).select(path).distinct()


# --- ignore rules ---------------------------------------------------------------------------


def ignore_rules(rule_files: DataFrame) -> DataFrame:
    """``root, rules`` from ``root, file_no, content``: compiled rules in file and line order.

    The array holds the lines of one root's ignore files, which are small by nature.
    """
    lines = rule_files.select(
        "root", "file_no", F.posexplode(F.split("content", "\n")).alias("line_no", "line")
    )
    return rules_from_lines(
        lines.select("root", F.struct("file_no", "line_no").alias("rule_no"), "line")
    )


def rules_from_lines(lines: DataFrame) -> DataFrame:
    """``root, rules`` from ``root, rule_no, line``."""
    parsed = lines.withColumn("p", parse_ignore_line(trim_space(F.col("line")))).filter(F.col("p").isNotNull())
    compiled = parsed.select(
        "root",
        F.struct(
            F.col("rule_no"),
            compile_rule(F.col("p.pattern")).alias("rule"),
            F.col("p.negated").alias("negated"),
            F.col("p.dir_only").alias("dir_only"),
        ).alias("r"),
    )
    return compiled.groupBy("root").agg(F.array_sort(F.collect_list("r")).alias("rules"))


def is_ignored(rules: Column, rel: Column, is_dir: Column) -> Column:
    """Last matching rule wins; an ignored ancestor directory hides everything below it.

    Rules are the outer loop, so each pattern is compiled once per path.
    """
    parts = F.split(rel, "/")
    ancestors = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("p"), F.lit(True).alias("d")),
    )
    itself = F.array(F.struct(rel.alias("p"), is_dir.alias("d")))
    root = F.array(F.struct(F.lit(".").alias("p"), F.lit(True).alias("d")))
    steps = F.array_distinct(F.concat(root, ancestors, itself))

    def apply(acc: Column, r: Column) -> Column:
        return F.transform(
            acc,
            lambda s: F.struct(
                s.p.alias("p"),
                s.d.alias("d"),
                F.when(rule_applies(r.rule, r.dir_only, s.p, s.d), ~r.negated).otherwise(s.ign).alias("ign"),
            ),
        )

    start = F.transform(steps, lambda s: F.struct(s.p.alias("p"), s.d.alias("d"), F.lit(False).alias("ign")))
    return F.aggregate(rules, start, apply, lambda acc: F.exists(acc, lambda s: s.ign))


def mark_ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``ignored`` to ``root, rel, is_dir, ...``; rules are per root (``root, rules``)."""
    joined = join_by_hash(paths, rules, ["rel"], "left", key="root")
    ignored = F.when(F.col("rules").isNotNull(), is_ignored(F.col("rules"), F.col("rel"), F.col("is_dir")))
    return joined.withColumn("ignored", F.coalesce(ignored, F.lit(False))).drop("rules")


def without_ignored(files: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """The files ``root, rel, ...`` that no rule ignores; contents ride along without moving.

    Rules that are small, as they mostly are, go to the files, once their size is checked. Otherwise paths alone are joined with the
    rules, and the files to leave out are then looked up by ``key``.
    """
    if small_enough(rules):
        joined = files.join(F.broadcast(rules), "root", "left")
        ignored = F.when(F.col("rules").isNotNull(), is_ignored(F.col("rules"), F.col("rel"), F.lit(False)))
        return joined.filter(~F.coalesce(ignored, F.lit(False))).select(*files.columns)
    paths = files.select(*dict.fromkeys([*key, "root", "rel"])).withColumn("is_dir", F.lit(False))
    gone = mark_ignored(paths, rules).filter("ignored").select(*key).distinct()
    same = [files[c].eqNullSafe(gone[c]) for c in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return files.join(gone, on, "left_anti")


def is_history_target(path: Column, roots, extras=(), history_file: str | None = None) -> Column:
    """A history file directly in a root, or one named explicitly."""
    named = [x for x in (*extras, history_file) if x]
    direct = dirname(path).isin([r.rstrip("/") or "/" for r in roots]) & is_history_file(basename(path))
    return direct | path.isin(named) if named else direct


def history_targets(corpus: DataFrame, roots, extras=(), history_file: str | None = None) -> DataFrame:
    """``path`` of the files to scrub, distinct and sorted; contents are not touched."""
    wanted = is_history_target(F.col("path"), roots, extras, history_file)
    return corpus.filter(wanted).select("path").distinct().orderBy("path")
