"""Patterns on names: key patterns, file globs, ignore rules and well-known file names.

Patterns are columns, so one implementation serves job parameters (literals, which the optimiser
folds into constant regular expressions) and rule tables (one pattern per row).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions.names import basename

# Parts of a file name that suggest a dump of secrets.
SUSPICIOUS_NAMES = (
    "bitwarden", "bw_export", "bwexport",
    "dashlane", "dashlane_export",
    "1password", "1pif", "1p_export",
    "password", "passwords", "secrets", "creds", "credentials",
    "env_export", "vault_export", "secret_dump", "key_dump",
    "export.json", "export.csv", ".env.backup", ".env.bak",
)
# Names of live history files.
HISTORY_NAMES = (
    ".bash_history", ".zsh_history", ".zhistory", ".history",
    ".sh_history", ".mksh_history", "fish_history",
)

_NEVER = "(?!)"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def key_matches(key: Column, pattern: str) -> Column:
    """Exact, or with one ``*``: prefix and suffix, which may overlap."""
    if pattern.count("*") != 1:
        return key == pattern if pattern else F.lit(False)
    prefix, suffix = pattern.split("*")
    return key.startswith(prefix) & key.endswith(suffix)


def key_ignored(key: Column, patterns: Iterable[str]) -> Column:
    return any_of(key_matches(key, p) for p in patterns)


def _escape(pattern: Column) -> Column:
    """A regular expression matching the text literally."""
    return F.regexp_replace(pattern, r"([\\.+*?^$|(){}\[\]])", r"\\$1")


def shell_regex(pattern: Column) -> Column:
    """Unanchored regular expression of a shell pattern; ``*`` and ``?`` stop at ``/``."""
    well_formed = pattern.rlike(r"^(?:[^\[\]\\]|\\.|\[\^?(?:\\.|[^\]\\])+\])*\z")
    escaped = F.regexp_replace(pattern, r"([.+$|(){}]|(?<!\[)\^)", r"\\$1")
    wild = F.regexp_replace(F.regexp_replace(escaped, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.when(well_formed, wild).otherwise(_NEVER)


def _whole(regex: Column) -> Column:
    return F.concat(F.lit("(?s)^(?:"), regex, F.lit(")\\z"))


def _found(name: Column, regex: Column) -> Column:
    # regexp_instr keeps the last compiled pattern; rlike compiles a non-constant one per call
    return F.regexp_instr(name, regex) > 0


def glob_matches(name: Column, pattern: Column) -> Column:
    """Exact or shell match of the name or its last part; a lone leading, trailing or inner ``*``
    also crosses ``/``; a leading ``**/`` is dropped."""
    clean = F.regexp_replace(F.regexp_replace(pattern, r"^\*\*/", ""), r"^\*\*", "")
    head = F.regexp_replace(clean, r"\*\z", "")
    tail = F.regexp_replace(clean, r"^\*", "")
    stars = F.char_length(clean) - F.char_length(F.replace(clean, F.lit("*"), F.lit("")))
    shell = _whole(shell_regex(clean))
    return (pattern != "") & (
        (name == pattern)
        | (name == clean)
        | _found(name, shell)
        | _found(basename(name), shell)
        | (clean.endswith("*") & (head != "") & F.startswith(name, head))
        | (clean.startswith("*") & (tail != "") & F.endswith(name, tail))
        | (
            (stars == 1)
            & F.startswith(name, F.substring_index(clean, "*", 1))
            & F.endswith(name, F.substring_index(clean, "*", -1))
        )
    )


def matches_any_glob(name: Column, patterns: Iterable[str]) -> Column:
    return any_of(glob_matches(name, F.lit(p)) for p in patterns)


def suspicious_format(name: Column) -> Column:
    """The format a file name suggests, NULL for an ordinary name."""
    lower = F.lower(name)
    hinted = any_of(F.contains(lower, F.lit(s)) for s in SUSPICIOUS_NAMES)
    by_suffix = (
        F.when(lower.endswith(".json"), "bitwarden_json")
        .when(lower.endswith(".csv"), "bitwarden_csv")
        .when(lower.endswith(".1pif"), "onepassword_1pif")
        .otherwise("suspicious_filename")
    )
    return F.when(hinted, by_suffix)


def is_rotated_history(name: Column) -> Column:
    """Backups and numbered copies of history files."""
    lower = F.lower(name)

    def backed_up(*marks: str) -> Column:
        return any_of(F.contains(lower, F.lit(m)) for m in marks) | lower.endswith("~")

    stems = []
    for stem in HISTORY_NAMES:
        related = lower.startswith(stem) | F.contains(lower, F.lit(stem.lstrip(".")))
        numbered = F.regexp_like(name, _whole(shell_regex(F.lit(f"*{stem}.[0-9]*"))))
        stems.append(related & (backed_up(".old", ".bak", ".backup", ".orig") | numbered))
    generic = F.contains(lower, F.lit("history")) & backed_up(".old", ".bak", ".1")
    return any_of(stems) | generic


def is_history_file(name: Column) -> Column:
    return name.isin(*HISTORY_NAMES) | is_rotated_history(name)


# --- ignore rules ---------------------------------------------------------------------------


def parse_ignore_line(line: Column) -> Column:
    """``struct<pattern,negated,dir_only>`` of a trimmed rule line; NULL for comments and blanks."""
    negated = line.startswith("!")
    body = F.when(negated, F.btrim(line.substr(F.lit(2), F.char_length(line)))).otherwise(line)
    return F.when(
        (line != "") & ~line.startswith("#"),
        F.struct(
            F.regexp_replace(body, "/\\z", "").alias("pattern"),
            negated.alias("negated"),
            body.endswith("/").alias("dir_only"),
        ),
    )


def _double_star_regex(pattern: Column) -> Column:
    """Parts between ``**`` in order. A part with ``*`` runs to the end of the name unless it ends
    in ``*``, and takes up as many characters as it is long."""

    def part(p: Column) -> Column:
        starred = F.contains(p, F.lit("*"))
        body = F.array_join(F.transform(F.split(p, "\\*"), _escape), ".*")
        end = F.when(p.endswith("*"), "").otherwise("\\z")
        return F.when(
            starred,
            F.concat(F.lit("(?="), body, end, F.lit(").{"), F.char_length(p).cast("string"), F.lit("}")),
        ).otherwise(_escape(p))

    parts = F.filter(F.split(pattern, "\\*\\*"), lambda p: p != "")
    return F.concat(F.lit("(?s)"), F.array_join(F.transform(parts, part), ".*"))


def compile_rule(pattern: Column) -> Column:
    """The regular expressions an ignore rule needs, computed once per rule.

    ``whole`` is tried on a full relative path, ``inside`` on any trailing part or single
    component of it, ``component`` on components only (``**`` rules).
    """
    anchored = pattern.startswith("/")
    bare = F.regexp_replace(pattern, "^/", "")
    double = F.contains(bare, F.lit("**"))
    shell = shell_regex(bare)
    starry = _double_star_regex(bare)
    tail = F.when(F.contains(bare, F.lit("/")), "\\z").otherwise("(?:/|\\z)")
    inside = F.concat(F.lit("(?s)(?:^|/)(?:"), shell, F.lit(")"), tail)
    raw_shell = shell_regex(pattern)
    return F.struct(
        pattern.alias("pattern"),
        bare.alias("bare"),
        anchored.alias("anchored"),
        double.alias("double"),
        F.when(double, starry).when(anchored, _whole(shell)).otherwise(inside).alias("regex"),
        F.when(F.contains(pattern, F.lit("**")), _double_star_regex(pattern))
        .otherwise(_whole(raw_shell))
        .alias("ancestor_regex"),
    )


def _matches_rule(rule: Column, rel: Column) -> Column:
    components = F.split(rel, "/")
    direct = _found(rel, rule.regex) | (rel == rule.bare)
    anchored = (direct | (~rule.double & _found(basename(rel), rule.regex))) & F.startswith(rel, rule.bare)
    floating = direct | (rule.double & F.exists(components, lambda s: _found(s, rule.regex)))
    return (rule.bare != "") & F.when(rule.anchored, anchored).otherwise(floating)


def _below_matching_dir(rule: Column, rel: Column) -> Column:
    """Some proper ancestor, by path or by name, matches the rule's own pattern."""
    parts = F.split(rel, "/")

    def hit(s: Column) -> Column:
        return (s == rule.pattern) | _found(s, rule.ancestor_regex)

    ancestors = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )
    named = F.exists(ancestors, lambda a: hit(a) | hit(basename(a)))
    return (rule.pattern != "") & named


def rule_applies(rule: Column, dir_only: Column, rel: Column, is_dir: Column) -> Column:
    """Whether a compiled rule decides about a relative path."""
    allowed = ~dir_only | is_dir | _below_matching_dir(rule, rel)
    return _matches_rule(rule, rel) & allowed
