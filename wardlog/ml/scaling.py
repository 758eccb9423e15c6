"""Min-max scaling and anomaly thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.constants import BOX_MULTIPLIER
from wardlog.functions.vectors import constant_array
from wardlog.operators.quantiles import median, quantiles


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes its distance from the minimum."""
    ends = [(F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")) for c in columns]
    bounds = df.agg(F.struct(*[e for pair in ends for e in pair]).alias("bounds")).scalar()
    out = {}
    for c in columns:
        lowest, highest = (bounds[f"{end}_{c}"].cast("double") for end in ("low", "high"))
        width = F.when(highest > lowest, highest - lowest).otherwise(1.0)
        out[c] = (F.col(c).cast("double") - lowest) / width
    return df.withColumns(out)


@dataclass
class Scaler:
    """Min-max scaling of sparse vectors.

    Places whose least value is 0 keep their zeros. The others, numbers mostly, get an
    entry in every row.
    """

    low: list[float]
    width: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replaces ``weights`` and, where zeros do not stay zeros, ``places``."""
        low, width = constant_array(self.low), constant_array(self.width)
        moved = [i for i, x in enumerate(self.low) if x != 0]
        entry = lambda p, w: F.struct(p.alias("place"), ((w - F.get(low, p)) / F.get(width, p)).alias("w"))
        old = F.arrays_zip("places", "weights")
        if not moved:
            entries = F.transform(old, lambda e: entry(e["places"], e["weights"]))
        else:
            where = F.array(*[F.lit(i) for i in moved])
            found = F.map_from_arrays("places", "weights")
            kept = F.filter(old, lambda e: ~F.array_contains(where, e["places"]))
            entries = F.concat(
                F.transform(where, lambda p: entry(p, F.coalesce(F.element_at(found, p), F.lit(0.0)))),
                F.transform(kept, lambda e: entry(e["places"], e["weights"])),
            )
        df = df.withColumn("_entries", F.sort_array(F.filter(entries, lambda e: e["w"] != 0)))
        return df.withColumns({"places": F.col("_entries.place"), "weights": F.col("_entries.w")}).drop("_entries")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.low, self.width)], "low array<double>, width array<double>") \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        row = spark.read.parquet(path).first()
        return cls(list(row.low), list(row.width))


def fit_scaler(df: DataFrame, size: int) -> Scaler:
    """Least and greatest value of each of ``size`` places; one partial aggregate over the entries."""
    entries = df.select(F.explode(F.arrays_zip("places", "weights")).alias("e"))
    ends = entries.groupBy(F.col("e.places").alias("place")).agg(
        F.min("e.weights").alias("low"), F.max("e.weights").alias("high"), F.count(F.lit(1)).alias("n")
    )
    rows, low, high = df.count(), [0.0] * size, [0.0] * size
    for r in ends.collect():  # a row a place
        # rows without an entry are zeros
        low[r.place] = r.low if r.n == rows else min(r.low, 0.0)
        high[r.place] = r.high if r.n == rows else max(r.high, 0.0)
    return Scaler(low, [h - m if h > m else 1.0 for m, h in zip(low, high, strict=True)])


def box_threshold(
    df: DataFrame, score: str, multiplier: float = BOX_MULTIPLIER, only: Column | None = None
) -> float:
    """Upper quartile plus a multiple of the quartile distance; ``only`` restricts the rows."""
    rows = df if only is None else df.where(only)
    q1, q3 = quantiles(rows, score, [0.25, 0.75])
    return q3 + multiplier * (q3 - q1)


def mad_scores(df: DataFrame, column: str, z: float) -> DataFrame:
    """Adds ``mad_score``: z times the distance from the median over the median distance."""
    middle = median(df, column)
    away = F.abs(F.col(column) - middle)
    spread = median(df.select(away.alias("away")), "away")
    return df.withColumn("mad_score", F.try_divide(z * away, F.lit(spread)))


def mad_threshold(df: DataFrame, column: str, z: float, threshold: float) -> DataFrame:
    """The value whose score is nearest the threshold, the smallest of equals."""
    scored = mad_scores(df, column, z)
    nearest = F.min(
        F.struct(F.abs(F.col("mad_score") - threshold).alias("gap"), F.col(column).alias("v"))
    )
    return scored.agg(nearest.alias("m")).select(F.col("m.v").alias("threshold"))
