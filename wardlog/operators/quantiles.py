"""Exact order statistics of a column without sorting it in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
SMALL = 10_000


def _histogram(counts: DataFrame, low: float, high: float) -> list:
    """Rows, ends and distinct values of at most BUCKETS equal slices of [low, high]."""
    # halves, as the distance of two numbers can be too large for one
    place = F.floor((F.col("value") / 2 - low / 2) / ((high / 2 - low / 2) / BUCKETS))
    return (
        counts.where(F.col("value").between(low, high))
        .groupBy(F.least(F.lit(BUCKETS - 1), place).alias("bucket"))
        .agg(
            F.sum("n").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count(F.lit(1)).alias("kinds"),
        )
        .orderBy("bucket")
        .collect()
    )


def _values_at(counts: DataFrame, ranks: Sequence[int], low: float, high: float, kinds: int):
    """The values at 0-based ranks of a (value, n) table.

    A range of values is narrowed by bucket counts until at most SMALL distinct
    values are left; the driver never sees more than that or BUCKETS rows.
    """
    if kinds <= SMALL:
        rows = iter(sorted(counts.where(F.col("value").between(low, high)).collect()))
        out, passed, value = {}, 0, low
        for rank in sorted(ranks):
            while passed <= rank:
                value, n = next(rows)
                passed += n
            out[rank] = value
        return out
    out, before = {}, 0
    for b in _histogram(counts, low, high):
        inside = [r - before for r in ranks if before <= r < before + b.n]
        if inside:
            found = _values_at(counts, inside, b.low, b.high, b.kinds)
            out.update({r + before: v for r, v in found.items()})
        before += b.n
    return out


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles, exact.

    Infinite values and NaN (above all numbers) are only counted; ranges are narrowed
    over the finite values.
    """
    value = F.col("value")
    counts = (
        df.select(F.col(column).cast("double").alias("value"))
        .where(value.isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        odd = F.isnan(value) | (F.abs(value) == math.inf)
        first, last, nan, size, low, high, kinds = counts.agg(
            F.sum(F.when(value == -math.inf, F.col("n")).otherwise(0)),
            F.sum(F.when(value == math.inf, F.col("n")).otherwise(0)),
            F.sum(F.when(F.isnan(value), F.col("n")).otherwise(0)),
            F.sum(F.when(~odd, F.col("n")).otherwise(0)),
            F.min(F.when(~odd, value)),
            F.max(F.when(~odd, value)),
            F.count_if(~odd),
        ).first()
        total = sum(n or 0 for n in (first, last, nan, size))
        if not total:
            raise ValueError("no values")
        places = [share * (total - 1) for share in shares]
        ranks = {r for p in places for r in (math.floor(p), math.ceil(p))}
        inside = sorted(r - first for r in ranks if first <= r < first + size)
        found = _values_at(counts.where(~odd), inside, low, high, kinds) if inside else {}
        at = {r + first: v for r, v in found.items()}
        for r in ranks - set(at):
            at[r] = -math.inf if r < first else math.inf if r < first + size + last else math.nan
        return [_between(at[math.floor(p)], at[math.ceil(p)], p - math.floor(p)) for p in places]
    finally:
        counts.unpersist()


def _between(low: float, high: float, share: float) -> float:
    return low if low == high or not share else low + share * (high - low)


def median(df: DataFrame, column: str) -> float:
    return quantiles(df, column, [0.5])[0]
