"""Column helpers on paths and ids: opaque ids, display names and masked locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions.text import sha256_hex

UNKNOWN_PROJECT = "(unknown project)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    d = F.regexp_replace(path, "/[^/]*\\z", "")
    return F.when(d == "", "/").otherwise(d)


def opaque_id(directory: Column) -> Column:
    """16 hex characters standing for a directory."""
    return F.left(sha256_hex(directory), F.lit(16))


def logical_id(source: Column) -> Column:
    """The opaque id of a whole source rather than of a directory."""
    return opaque_id(F.concat(F.lit("logical:"), source))


def display_name(directory: Column) -> Column:
    """The last two parts of a directory."""
    parts = F.split(F.regexp_replace(directory, "/\\z", ""), "/")
    return (
        F.when(directory.isin("", "/"), directory)
        .when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/"))
        .otherwise(F.element_at(parts, -1))
    )


def fallback_name(project_id: Column) -> Column:
    """A short form of an id for which no display name is known."""
    p = F.btrim(project_id, F.lit("/"))
    return F.when(p == "", UNKNOWN_PROJECT).otherwise(F.concat(F.lit(".../"), F.substring_index(p, "/", -2)))


def masked_location(path: Column, home: str = "") -> Column:
    """First path component and file name only; below ``home`` counted from there."""

    def ends(rel: Column) -> Column:
        first, last = F.substring_index(rel, "/", 1), F.substring_index(rel, "/", -1)
        return F.concat_ws("/", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))

    def plain(rel: Column) -> Column:
        return F.when(F.instr(rel, "/") > 0, ends(rel)).otherwise(rel)

    root_rel = F.regexp_replace(path, "^/", "")
    deep = F.size(F.split(root_rel, "/")) > 2
    outside = F.when(path.startswith("/") & deep, ends(root_rel)).otherwise(basename(path))
    if not home:
        return outside
    below = F.regexp_replace(path.substr(F.lit(len(home) + 1), F.char_length(path)), "^/", "")
    return F.when(path.startswith(home), plain(below)).otherwise(outside)
