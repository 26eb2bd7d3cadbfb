"""Join and filter shapes that hold up when one key owns a large part of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8
# Heavy keys that are told apart, and counters of the sketch that finds them: a key with over 1/COUNTERS of the rows is among them.
HEAVY_KEYS, COUNTERS = 256, 10_000
# A bitmap of key prefixes has 2^PREFIX_BITS bits, 2 MB, whatever the number of keys.
PREFIX_BITS, BITMAP_BITS = 24, 1 << 15
# Tasks for each core where rows are dealt evenly.
TASKS_A_CORE = 4


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, ahead of work that takes long for each of them.

    A row group of a file is read by one task, and in narrow tables it holds a million rows. Deal the narrow rows, before texts are made of them."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` without copying the condition's inputs below the projection.

    The optimiser pushes a filter through a projection by repeating its expressions. Where these
    read whole texts that doubles the scan work. A condition on the output of an outer generator
    stays where it is.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.select(F.explode_outer(F.when(condition, F.array(row))).alias("_row"))
    return kept.filter(F.col("_row").isNotNull()).select("_row.*")


def _salted(df: DataFrame, salts: int) -> DataFrame:
    """Every row once per salt value."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salt_of(columns: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def join_by_hash(
    rows: DataFrame, lookup: DataFrame, spread_by: list[str], how: str = "left", key: str = "hash", salts: int = SALTS
) -> DataFrame:
    """Join ``rows`` with a ``lookup`` that has one row per key.

    No side is broadcast by hand: adaptive execution turns the join into a broadcast once the
    measured size of the lookup allows it. Beyond that the rows of one key are spread over
    ``salts`` partitions by ``spread_by`` and the lookup, which is the small side, is repeated.
    Rows without a key are spread by the same columns instead of meeting in one partition.
    """
    probe = rows.withColumn("_salt", _salt_of(spread_by, salts)).withColumn(
        "_key", F.coalesce(F.col(key), F.concat(F.lit("-"), F.xxhash64(*spread_by).cast("string")))
    )
    side = _salted(lookup.withColumnRenamed(key, "_key"), salts)
    return probe.join(side, ["_key", "_salt"], how).drop("_key", "_salt")


def heavy_keys(rows: DataFrame, key: str = "hash", partitions: int | None = None, part: float = 0.5) -> dict[str, int]:
    """How many partitions each heavy key needs: keys with more than ``part`` of the rows of a mean partition, by a mergeable sketch.

    One job over the key column of ``rows``, which should be a stored table. At most ``HEAVY_KEYS`` come back; there can't be more, unless
    partitions outnumber them by far. Rows without a key don't count."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(HEAVY_KEYS, max(1, math.ceil(n / part)))
    top = F.expr(f"approx_top_k(`{key}`, {most}, {COUNTERS})").alias("top")
    found = rows.filter(F.col(key).isNotNull()).agg(top, F.count(F.lit(1)).alias("n")).first()
    mean = found["n"] / n
    return {t["item"]: math.ceil(t["count"] / (part * mean)) for t in found["top"] or [] if t["count"] > part * mean}


def join_spread(rows: DataFrame, lookup: DataFrame, heavy: dict[str, int], spread_by: list[str], how: str = "left", key: str = "hash") -> DataFrame:
    """As ``join_by_hash``, with salts for the ``heavy`` keys alone, as many as each of them needs.

    A heavy key's rows are spread over its salts and its lookup row is sent once for each; all other keys join plainly, and the lookup is sent
    once. The counts of ``heavy`` only place rows, so an estimate that is off changes no result."""
    heavy = {k: n for k, n in heavy.items() if n > 1}
    spread = F.xxhash64(*spread_by)
    lonely = F.concat(F.lit("-"), spread.cast("string"))
    if not heavy:
        probe = rows.withColumn("_key", F.coalesce(F.col(key), lonely))
        return probe.join(lookup.withColumnRenamed(key, "_key"), "_key", how).drop("_key")
    salts = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
    own = F.coalesce(salts[F.col(key)], F.lit(1))
    probe = rows.withColumns({"_salt": F.pmod(spread, own).cast("int"), "_key": F.coalesce(F.col(key), lonely)})
    side = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), own - 1))).withColumnRenamed(key, "_key")
    return probe.join(side, ["_key", "_salt"], how).drop("_key", "_salt")


def _prefix(hex_key: Column) -> Column:
    """The first bits of a key in hex as a number from 1 on."""
    return F.conv(F.left(hex_key, F.lit(PREFIX_BITS // 4)), 16, 10).cast("long") + 1


def prefix_bitmap(keys: DataFrame, key: str = "hash") -> Column:
    """The prefixes of all hex keys as bitmaps, a value of at most ``2^PREFIX_BITS`` bits that a query computes once.

    Bitmaps are united by partial aggregation, so the keys themselves don't move."""
    place = keys.select(_prefix(F.col(key)).alias("at")).filter(F.col("at").isNotNull())
    parts = place.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    by_bucket = F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))
    every = F.sequence(F.lit(1), F.lit((1 << PREFIX_BITS) // BITMAP_BITS))
    return parts.agg(F.transform(every, lambda b: F.element_at(by_bucket, b.cast("long"))).alias("bitmap")).scalar()


def may_be_in(hex_key: Column, bitmap: Column) -> Column:
    """False where no key of the bitmap has the prefix of this one: it is certainly not among them."""
    at = _prefix(hex_key)
    bits = F.element_at(bitmap, F.bitmap_bucket_number(at).cast("int"))
    position = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 1, F.lit(False))


def small_enough(df: DataFrame, max_bytes: int = 8 << 20) -> bool:
    """Whether the rows fit in ``max_bytes`` as JSON; looks at no more than needed to know."""
    size = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).limit(max_bytes // 16)
    found = size.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    return found["rows"] < max_bytes // 16 and found["bytes"] <= max_bytes
