"""Gaps between events, caps, splits and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.session import stored


def _seconds(rows: DataFrame, key: str, ts: str, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per (key, second) with its count; at most 86,400 per key and day."""
    return rows.groupBy(key, F.date_trunc("second", ts).cast("timestamp_ntz").alias("second")).agg(
        F.count(F.lit(1)).alias("n"), *extra
    )


def _previous(seconds: DataFrame, key: str) -> DataFrame:
    """Adds the second before, per key, without ordering a whole key in one task.

    Within a day a plain lag does it; a day's first second takes the last one of
    the key's latest earlier day, found on one row per (key, day).
    """
    seconds = seconds.withColumn("day", F.to_date("second"))
    inner = Window.partitionBy(key, "day").orderBy("second")
    days = seconds.groupBy(key, "day").agg(F.max("second").alias("last"))
    before = days.select(
        key,
        F.col("day"),
        F.lag("last").over(Window.partitionBy(key).orderBy("day")).alias("last_before"),
    )
    return (
        seconds.withColumn("previous", F.lag("second").over(inner))
        .join(before, [key, "day"])
        .withColumn("previous", F.coalesce("previous", "last_before"))
        .drop("last_before")
    )


def _span(later: Column, earlier: Column) -> Column:
    return F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))


def gaps(rows: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Each event with the seconds since the one before it; NULL for a key's first."""
    seconds = _previous(_seconds(rows, key, ts, [F.min(order).alias("_first")]), key)
    gap = F.when(
        F.col(order) == F.col("_first"), _span(F.col("second"), F.col("previous"))
    ).otherwise(F.lit(0).cast("bigint"))
    second = F.date_trunc("second", ts).cast("timestamp_ntz")
    return (
        rows.withColumn("second", second)
        .join(seconds.select(key, "second", "previous", "_first"), [key, "second"])
        .withColumn("gap", gap)
        .drop("second", "previous", "_first")
    )


def gap_statistics(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Mean gap and its standard deviation (2 decimals) per key; 0 below two events.

    Events of one second are 0 apart, so seconds with counts hold everything:
    sums of gaps and squared gaps over them are the sums over events.
    """
    gap = _span(F.col("second"), F.col("previous")).cast("double")
    sums = (
        _previous(_seconds(rows, key, ts), key)
        .groupBy(key)
        .agg(
            (F.sum("n") - 1).alias("_gaps"),
            F.sum(gap).alias("_sum"),
            F.sum(gap * gap).alias("_squares"),
        )
    )
    mean = F.try_divide(F.coalesce("_sum", F.lit(0.0)), F.col("_gaps"))
    square = F.try_divide(F.coalesce("_squares", F.lit(0.0)), F.col("_gaps"))
    deviation = F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 2)
    return sums.select(
        key,
        (F.col("_gaps") + 1).alias("events"),
        F.coalesce(mean, F.lit(0.0)).alias("diff_avg"),
        F.coalesce(deviation, F.lit(0.0)).alias("diff_std"),
    )


# Up to so many rows are found by keeping the first ones of each task.
FEW = 10_000


def first_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first n rows in key order."""
    if n <= FEW:
        return df.orderBy(*keys).limit(n)
    one = df.withColumn("_class", F.lit(0))
    return cap_per_class(one, "_class", keys, n).drop("_class")


def nth_keys(df: DataFrame, label: str, keys: Sequence[str], n: int) -> DataFrame:
    """(label, bound): the n-th key of each class in key order; classes with fewer rows are left out.

    Keys alone are sorted into ranges. The rows of a class are counted per range, which
    tells the range that holds the n-th one and its place there; no task ranks a class.
    """
    order = [label, *keys]
    sorted_ = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits are the range, the lower ones the place in it
    placed = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()), "sorted-keys")
    ranges = placed.groupBy(label, F.shiftright("_at", 33).alias("_range")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    ahead = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    holding = ranges.where((F.col("_ahead") < n) & (F.col("_ahead") + F.col("_rows") >= n))
    wanted = holding.select((F.col("_first") + n - 1 - F.col("_ahead")).alias("_at"))
    return placed.join(wanted, "_at").select(label, F.struct(*keys).alias("bound"))


def cap_per_class(df: DataFrame, label: str, keys: Sequence[str], n: int | None) -> DataFrame:
    """At most n rows per class, the first in key order; all where n is None.

    Rows below the class's n-th key are kept by one comparison. Of rows that have that
    very key as many are kept as are missing.
    """
    if n is None:
        return df
    bounds = stored(nth_keys(df, label, keys, n).withColumnRenamed(label, "_label"), "bounds")
    key = F.struct(*keys)
    rows = df.join(bounds, F.col(label).eqNullSafe(F.col("_label")), "left")
    below = rows.where(F.col("bound").isNull() | (key < F.col("bound"))).select(*df.columns)
    counts = rows.where(F.col("bound").isNotNull()).groupBy(F.col("_label").alias("_cut_class"))
    missing = counts.agg((n - F.count_if(key < F.col("bound"))).alias("_missing"))
    last = rows.where(key == F.col("bound")).join(missing, F.col("_label").eqNullSafe(F.col("_cut_class")))
    among = Window.partitionBy("_label").orderBy(F.xxhash64(*df.columns))
    last = last.withColumn("_rank", F.row_number().over(among)).where((F.col("_rank") <= n) & (F.col("_rank") <= F.col("_missing")))
    return below.unionByName(last.select(*df.columns))


def hash_slot(keys: Sequence[str], slots: int = 100) -> Column:
    """A number in 0..slots-1 that depends only on the keys."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(slots))


def sample_per_class(
    df: DataFrame, label: str, keys: Sequence[str], shares: dict[str, float]
) -> DataFrame:
    """About the wanted share of each class, chosen by key hash; other classes are left out."""
    pairs = [F.lit(v) for name, share in shares.items() for v in (name, round(share * 10_000))]
    wanted = F.element_at(F.create_map(*pairs), F.col(label))
    return df.where(hash_slot(keys, 10_000) < wanted)


def with_split(df: DataFrame, keys: Sequence[str], train_percent: int = 70) -> DataFrame:
    """Adds ``split``: train or test, the same on every run."""
    chosen = hash_slot(keys) < train_percent
    return df.withColumn("split", F.when(chosen, "train").otherwise("test"))


def alerts_first(df: DataFrame, name: str = "att_name", seed: int = 1) -> DataFrame:
    """Alerts before normal rows, each in an order no column tells.

    The order is a hash of the row: it is the same on a retry, and it lets the
    sort cut both groups into ranges of any size.
    """
    return df.orderBy(F.col(name) == "NORMAL", F.xxhash64(F.lit(seed), *df.columns))


def last_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key the row with the largest ``order``; of equals the one with the largest values."""
    rest = [c for c in df.columns if c not in keys]
    others = [c for c in rest if c != order]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *others)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
