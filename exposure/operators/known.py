"""Looking candidates up in the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.extract import candidate_hashes, candidates
from exposure.functions.text import sha256_hex
from exposure.operators.joins import heavy_keys, join_by_hash, join_spread, may_be_in, prefix_bitmap
from exposure.params import PLACEHOLDER, Gate
from exposure.shared import folder


def known_values(rows: DataFrame, registry: DataFrame, spread_by: list[str]) -> DataFrame:
    """The rows whose ``hash`` the registry holds (``registry`` has one row per hash)."""
    return join_by_hash(rows, registry.select("hash"), spread_by, "left_semi")


def count_known(df: DataFrame, id_cols: list[str], hashes: str, registry: DataFrame) -> DataFrame:
    """Replace the array column ``hashes`` by ``known``, how many of them the registry holds.

    One pass over ``df``: the other columns ride along as grouping columns, rows without any hash
    included, so keep them narrow and ``id_cols`` unique. Partial aggregation folds each row's
    hashes before the shuffle.
    """
    carried = [c for c in df.columns if c != hashes]
    rows = df.select(*carried, F.explode_outer(hashes).alias("hash"))
    lookup = registry.select("hash", F.lit(1).alias("_hit"))
    flagged = join_by_hash(rows, lookup, [*id_cols, "hash"])
    return flagged.groupBy(*carried).agg(F.count("_hit").alias("known"))


def known_per_text(df: DataFrame, id_cols: list[str], text: str, registry: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """``id_cols, known``: distinct known secrets per text, zero rows included."""
    hashes = df.select(*id_cols, candidate_hashes(text, gate).alias("_hashes"))
    return count_known(hashes, id_cols, "_hashes", registry)


def known_measured(df: DataFrame, id_cols: list[str], text: str, registry: DataFrame, gate: Gate = Gate(), store: str | None = None) -> DataFrame:
    """As ``known_per_text``, for large corpora: candidates that can't be known are dropped before anything moves, and heavy secrets are spread by
    their measured share.

    A candidate is tested in its row against a bitmap of the registry's prefixes (2 MB at most). What may be known is stored below
    ``store``, ids and hashes only; a sketch over it finds the secrets that so many texts share that they need several partitions, and only
    these are salted. Texts without a candidate left don't take part in the join. ``registry`` is read twice and should be a stored table. ``id_cols`` must be unique.
    """
    spark = df.sparkSession
    bitmap = prefix_bitmap(registry)
    hashes = df.select(*id_cols, candidate_hashes(text, gate).alias("_hashes"), bitmap.alias("_bitmap"))
    likely = hashes.select(*id_cols, F.filter("_hashes", lambda h: may_be_in(h, F.col("_bitmap"))).alias("_hashes"))
    path = store or folder(spark, "likely-")
    likely.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(likely.schema).parquet(path)
    rows = stored.select(*id_cols, F.explode("_hashes").alias("hash"))
    found = join_spread(rows, registry.select("hash"), heavy_keys(rows), [*id_cols, "hash"], "left_semi")
    none = stored.select(*id_cols, F.lit(0).cast("long").alias("known"))
    return found.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("known")).unionByName(none).groupBy(*id_cols).agg(F.sum("known").alias("known"))


def output_check(captures: DataFrame, registry: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Known secrets in captured command output, counted for failed commands too.

    ``captures``: ``capture_id, ok, output``; gives ``capture_id, status, secrets_found``.
    """
    hashes = captures.select("capture_id", "ok", candidate_hashes("output", gate).alias("_hashes"))
    return count_known(hashes, ["capture_id"], "_hashes", registry).select(
        "capture_id",
        F.when(F.col("ok"), "ok").otherwise("error").alias("status"),
        F.col("known").alias("secrets_found"),
    )


def known_hashes_by_id(df: DataFrame, id_cols: list[str], hashes: str, registry: DataFrame) -> DataFrame:
    """``id_cols, known_hashes`` for the ids that hold at least one known secret.

    The array holds hashes of one text's own candidates, so its size is bounded by that text.
    """
    rows = df.select(*id_cols, F.explode_outer(hashes).alias("hash")).filter(F.col("hash").isNotNull())
    known = known_values(rows, registry, [*id_cols, "hash"])
    return known.groupBy(*id_cols).agg(F.collect_set("hash").alias("known_hashes"))


def known_candidates(text: Column | str, known_hashes: Column, gate: Gate = Gate()) -> Column:
    """The candidates of a text whose hashes are listed, in ascending order."""
    return F.filter(candidates(text, gate), lambda c: F.array_contains(known_hashes, sha256_hex(c)))


def replace_all(text: Column, values: Column, placeholder: str = PLACEHOLDER, longest_first: bool = False) -> Column:
    """Replace each value literally, one after the other.

    In ascending order a short secret inside a longer one is replaced first and leaves the rest
    of the longer one standing; ``longest_first`` avoids that.
    """
    if longest_first:
        keyed = F.array_sort(F.transform(values, lambda v: F.struct(-F.char_length(v), v.alias("v"))))
        values = F.transform(keyed, lambda s: s.v)
    return F.aggregate(values, text, lambda acc, v: F.replace(acc, v, F.lit(placeholder)))


def redact_texts(
    df: DataFrame,
    id_cols: list[str],
    text: str,
    registry: DataFrame,
    gate: Gate = Gate(),
    placeholder: str = PLACEHOLDER,
    longest_first: bool = False,
) -> DataFrame:
    """``df`` with ``text`` redacted and ``secrets``, the number of distinct values replaced.

    Only ids and hashes are shuffled to find out which texts hold secrets; candidates are
    extracted again inside the few rows that do.
    """
    hashes = df.select(*id_cols, candidate_hashes(text, gate).alias("_hashes"))
    found = known_hashes_by_id(hashes, id_cols, "_hashes", registry)
    joined = df.join(found, id_cols, "left")
    values = F.when(
        F.col("known_hashes").isNotNull(), known_candidates(F.col(text), F.col("known_hashes"), gate)
    )
    return (
        joined.withColumn("_values", values)
        .withColumn(
            text,
            F.when(
                F.col("_values").isNotNull(), replace_all(F.col(text), F.col("_values"), placeholder, longest_first)
            ).otherwise(F.col(text)),
        )
        .withColumn("secrets", F.coalesce(F.size("known_hashes"), F.lit(0)))
        .drop("_values", "known_hashes")
    )
