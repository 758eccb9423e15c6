"""Gapless ranks inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, LEAST_BLOCKS = 20_000, 64


def gapless_ranks(df: DataFrame, group: str, order: Column, name: str = "rank", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds a rank from 0 without gaps inside each group, in the order of a hash.

    ``order`` must be a 64-bit hash: its upper bits cut a group into blocks of about
    ``block_rows`` rows (``LEAST_BLOCKS`` blocks at least), blocks are ranked on their own, and the rows before a block
    are counted from the block sizes. ``df`` must give the same rows whenever it is
    read: it is read twice.
    """
    rows = df.count()
    blocks = max(LEAST_BLOCKS, -(-rows // block_rows))
    # the hash as a number from 0 to blocks - 1, growing with the hash
    part = F.least(F.floor((order / F.lit(2.0**64) + 0.5) * blocks), F.lit(blocks - 1)).cast("int")
    keyed = df.withColumns({"_order": order, "_block": part})
    sizes = keyed.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # the window sees one row a block
    before = sizes.select(
        F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_block").orderBy("_order", *sorted(df.columns))
    ranked = keyed.withColumn("_place", F.row_number().over(inside) - 1)
    ranked = ranked.join(before, ranked[group].eqNullSafe(before["_g"]) & (F.col("_block") == F.col("_b")), "left")
    return ranked.select(*df.columns, (F.col("_before") + F.col("_place")).cast("bigint").alias(name))
