"""Neighbouring rows on the time line of a key, also when one key owns most of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.shared import folder

# Rows of a piece of a time line, about.
PIECE_ROWS = 1_000_000


def cut(df: DataFrame, key: str, order: list[str], rows: int = PIECE_ROWS, store: str | None = None) -> DataFrame:
    """The rows, stored, with ``_piece``: a number that doesn't decrease along ``order`` of a ``key``, each for about ``rows`` rows.

    Pieces are ranges of (key, order) that a sample of the rows decides, so a key is cut by its number of rows, not by its time: one
    with half of all rows in a second is in as many pieces as one that has them in a year. Rows equal in key and order stay together;
    fold these first where there can be many. The pieces are written before anything reads them, so a lost task finds the same ones.
    """
    spark = df.sparkSession
    store = store or folder(spark, "timeline-")
    df.write.parquet(f"{store}/rows")
    plain = spark.read.schema(df.schema).parquet(f"{store}/rows")
    pieces = max(1, math.ceil(plain.count() / rows))
    ranged = plain.repartitionByRange(pieces, key, *order).withColumn("_piece", F.spark_partition_id())
    ranged.write.parquet(f"{store}/pieces")
    return spark.read.schema(ranged.schema).parquet(f"{store}/pieces")


def with_neighbour(
    df: DataFrame, key: str, order: list[str], value: Column, name: str, bucket: Column, forward: bool = False
) -> DataFrame:
    """Add ``name``: ``value`` of the row before (or after) in ``order``, per ``key``.

    Time lines are cut into ``bucket`` pieces which are windowed apart; only the one end row of
    each piece is looked at across pieces. ``bucket`` must not decrease along ``order``.
    """
    cut = df.withColumn("_b", bucket).withColumn("_v", F.struct(value.alias("v")))
    direction = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    inside = Window.partitionBy(key, "_b").orderBy(*direction)
    pick = F.min_by if forward else F.max_by
    ends = cut.groupBy(key, "_b").agg(pick("_v", F.struct(*order)).alias("_end"))
    step = F.col("_b").desc() if forward else F.col("_b").asc()
    across = ends.select(key, "_b", F.lag("_end").over(Window.partitionBy(key).orderBy(step)).alias("_edge"))
    near = cut.withColumn("_n", F.lag("_v").over(inside)).join(across, [key, "_b"])
    return near.withColumn(name, F.coalesce("_n", "_edge")["v"]).drop("_b", "_v", "_n", "_edge")
