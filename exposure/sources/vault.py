"""Password-vault listings (JSON arrays of items) as a source of secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.globs import any_of
from exposure.functions.names import logical_id
from exposure.functions.text import let, parse_json, sha256_hex
from exposure.operators.residue import json_items, json_text

MIN_NOTE_BYTES = 9


def parse_items(items: Column) -> Column:
    """The items of a listing as variants; NULL unless it is an array of objects (or nulls)."""

    def checked(elements: Column) -> Column:
        odd = F.exists(
            elements,
            lambda i: let(F.schema_of_variant(i), lambda t: ~(t.startswith("OBJECT") | (t == "VOID"))),
        )
        return F.when(~odd, elements)

    return let(F.try_variant_get(parse_json(items), "$", "array<variant>"), checked)


def item_values(item: Column, ignore=()) -> Column:
    """Secret values of an item: login password, notes of more than 8 bytes, field values and a
    top-level password, without those that contain an ignored string."""
    notes = let(json_text(item, "$.notes"), lambda n: F.when(F.octet_length(n) >= MIN_NOTE_BYTES, n))
    fields = F.transform(json_items(item, "$.fields"), lambda f: json_text(f, "$.value"))
    values = F.concat(
        F.array(
            json_text(item, "$.login.password"),
            notes,
        ),
        fields,
        F.array(json_text(item, "$.password")),
    )
    ignored = [x for x in ignore if x]
    return F.filter(values, lambda v: (v != "") & ~any_of(F.contains(v, F.lit(x)) for x in ignored))


def vault_hashes(exports: DataFrame, carry: list[str], items: str = "items", ignore=()) -> DataFrame:
    """``carry, item_no, hash``, one row per secret value (repeats included)."""
    opened = exports.select(*carry, F.posexplode_outer(parse_items(F.col(items))).alias("item_no", "_item"))
    hashes = F.transform(item_values(F.col("_item"), ignore), sha256_hex)
    return opened.select(*carry, "item_no", F.explode_outer(hashes).alias("hash")).filter(
        F.col("hash").isNotNull()
    )


def contributions(exports: DataFrame, source: str = "vault", ignore=()) -> DataFrame:
    """``hash, project_id, seen_at, source`` from ``items, exported_at``."""
    return vault_hashes(exports, ["exported_at"], ignore=ignore).select(
        "hash",
        logical_id(F.lit(source)).alias("project_id"),
        F.col("exported_at").alias("seen_at"),
        F.lit(source).alias("source"),
    )


def invalid(exports: DataFrame, items: str = "items") -> DataFrame:
    """One error row per listing that could not be read. The test is on the output of an outer generator, so that it stays where the rows have been dealt to."""
    error = F.when(parse_items(F.col(items)).isNull(), F.array(F.lit("vault listing is not valid")))
    return exports.select(F.explode_outer(error).alias("error")).filter(F.col("error").isNotNull())
