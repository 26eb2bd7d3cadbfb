"""Mixing sources to target weights by Poisson replication (native columns only).

A source of weight w and m characters is read ``w / sum of w * total / m`` times on average (total: characters of all
sources, times ``scale``), so its share of the result is its weight. Each row is repeated k times, k drawn by inverting
the Poisson distribution of that mean at a number in [0, 1) made from the MD5 of seed, doc_id and text; so a row's
count depends on nothing else, and a repeated task draws it again. Then all copies are sorted by the MD5 of their seed, doc_id, text and
copy number: a global shuffle that doesn't depend on partitions. A row of many copies is written as blocks of at most ``COPIES`` of them, and
where the highest rate can give a row several blocks, these are dealt to all tasks before they are filled. Numbers of copies are int, as long as the highest rate allows, else long.

Without ``weights`` every source weighs the same. Nulls: a null source is a source; a null text counts as no characters; a
source without characters has rate 1. Rows that repeat are drawn alike. Weights for unknown sources are of no effect; sources
without a weight go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.scratch import saved

BROADCAST_ROWS = 10_000
COPIES = 1 << 16


def uniform(key: Column) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of the key."""
    digest = F.md5(key.cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def log_poisson(k: Column, rate: Column) -> Column:
    """ln of the probability of k > 0, by Stirling's series and the deviance of k from the mean, which both lose no digits at high rates."""
    d = (k - rate) / rate
    # (1 + d) ln(1 + d) - d, near 0 by its power series.
    series = sum((F.pow(d, F.lit(n)) * ((-1) ** n / (n * (n - 1))) for n in range(2, 11)), F.lit(0.0))
    deviance = rate * F.when(F.abs(d) < 0.02, series).otherwise((1 + d) * F.log1p(d) - d)
    rest = 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3))) + 1 / (1260 * F.pow(k, F.lit(5)))
    return -(deviance + rest + 0.5 * F.log(2 * math.pi * k))


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k whose cumulative probability is over u, at any rate. The sum covers 12 standard deviations either side of the mean; beyond these
    nothing is left that 48 bits could show. So the work of a row goes with the root of its rate."""
    far = 12 * F.sqrt(rate) + 30
    top = F.ceil(rate + far).cast("long")
    low = F.when(rate - far < 100, F.lit(0)).otherwise(F.floor(rate - far)).cast("long")
    first = F.exp(F.when(low == 0, -rate).otherwise(log_poisson(low.cast("double"), rate)))
    start = F.struct(first.alias("p"), first.alias("sum"), low.alias("k"), (u < first).alias("found"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        total = s["sum"] + p
        return F.when(s["found"], s).otherwise(F.struct(p.alias("p"), total.alias("sum"), i.alias("k"), (u < total).alias("found")))

    return F.aggregate(F.sequence(low + 1, top), start, step)["k"]


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """``_source, _rate``: mean repetitions of the rows of each source."""
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("_chars"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()), "name string, _weight double")
        weighed = sizes.join(table, F.col("_source").eqNullSafe(F.col("name"))).drop("name")
    whole, weight = weighed.agg(F.sum("_chars")).scalar(), weighed.agg(F.sum("_weight")).scalar()
    share = F.col("_weight") / weight * whole / F.col("_chars")
    rate = F.when(F.col("_chars") > 0, share * scale).otherwise(F.lit(1.0))
    return weighed.select("_source", rate.alias("_rate"))


def in_blocks(keyed: DataFrame, most: float) -> DataFrame:
    """``_all, _key, _copy`` of rows ``_all, _key, _count``, whose mean count is at most ``most``."""
    kind = "int" if most < 1 << 30 else "long"
    if most <= COPIES / 2:
        return keyed.select("_all", "_key", F.explode(F.sequence(F.lit(0), (F.col("_count") - 1).cast(kind))).alias("_copy"))
    blocks = keyed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_count - 1) div {COPIES}"))))
    first = F.col("_block") * COPIES
    last = F.least(first + COPIES, F.col("_count")) - 1
    return blocks.repartition("_key", "_block").select("_all", "_key", F.explode(F.sequence(first.cast(kind), last.cast(kind))).alias("_copy"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, scale: float = 1.0, seed: int = 42, number: str | None = "copy") -> DataFrame:
    """The rows, each as often as drawn, in global random order; ``number`` names a column for the number of the copy, from 0."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    packed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("source").alias("_of"), key.alias("_key"))
    rates = saved(repetition_rates(docs, weights, scale))
    size = rates.agg(F.count("*").alias("rows"), F.coalesce(F.max("_rate"), F.lit(0.0)).alias("most")).first()
    if size["rows"] <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    rated = packed.join(rates, F.col("_of").eqNullSafe(F.col("_source")))
    counted = rated.withColumn("_count", poisson_count(uniform(F.col("_key")), F.col("_rate"))).where("_count > 0")
    keyed = counted.select("_all", F.md5(F.col("_key").cast("binary")).alias("_key"), "_count")
    copies = in_blocks(keyed, size["most"])
    mixed = copies.orderBy(F.md5(F.concat_ws("|", "_key", F.col("_copy").cast("string")).cast("binary")), "_copy")
    return mixed.select("_all.*", *([F.col("_copy").alias(number)] if number else []))
