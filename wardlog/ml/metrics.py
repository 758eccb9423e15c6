"""One-vs-rest scores per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_vs_rest(df: DataFrame, label: str, predicted: str, skip: tuple[str, ...] = ("ANOMALY",)):
    """Counts, accuracy, recall, precision and F1 of each class that is ever predicted.

    Everything follows from the counts of (label, predicted), a table of at most
    classes squared rows.
    """
    pairs = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = pairs.agg(F.sum("n")).scalar()
    each = pairs.withColumn("attack_name", F.explode(F.array_distinct(F.array("y", "p"))))
    is_y, is_p = F.col("y") == F.col("attack_name"), F.col("p") == F.col("attack_name")

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    cells = each.groupBy("attack_name").agg(
        count(is_y & is_p).alias("tp"), count(~is_y & is_p).alias("fp"),
        count(is_y & ~is_p).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    # Only classes found on both sides are scored.
    cells = cells.where((tp + fp > 0) & (tp + fn > 0) & ~F.col("attack_name").isin(*skip))
    cells = cells.withColumn("tn", total - tp - fp - fn)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return cells.withColumns(
        {
            "train_cnt": tp + fp,
            "test_cnt": tp + fn,
            "accuracy": ratio(tp + F.col("tn"), total),
            "recall": ratio(tp, tp + fn),
            "precision": ratio(tp, tp + fp),
            "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )
