"""From class scores to labelled result rows, evidence and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.constants import DISPLAY_NAMES, RESULT_COLUMNS
from wardlog.functions.vectors import array_median, by_score, display_name, lookup, result_code
from wardlog.ml.slots import times_constant

STATUS_COLUMNS = [
    "dst_port_cnt", "info_st", "succ_st", "redir_st", "cler_st", "serer_st", "oth_st",
]
# What the result columns nobody computes hold.
RESULT_DEFAULTS = {
    "rule": "-", "src_ip_country_code": "-", "dst_ip_country_code": "-", "ast_ip": 0,
    "related_ip": 0, "direction_inout": "-", "direction_inout_bin": 0,
    "related_country": "-", "packet": 0, "if_label": 0, "if_score": 0, "lof_label": 0,
    "lof_score": 0, "ai_label": 0, "ai_score": 0,
}


def final_labels(
    df: DataFrame, labels: Sequence[str], threshold: float | None, model_id: int
) -> DataFrame:
    """Adds att_name, result, is_hit and max_score from the class scores.

    With a threshold (training) a normal score above it is an anomaly. Where no
    attack and no anomaly passes 0.5 the row is normal. The first class above
    0.5 in label order, anomaly last, is the answer.
    """
    attacks = [c for c in labels if c != "normal"]
    flag = F.when(F.col("normal") > threshold, 1.0).otherwise(0.0) if threshold is not None else F.lit(0.0)
    df = df.withColumn("anomaly_score", F.col("normal")).withColumn("anomaly", flag)
    quiet = F.col("anomaly") <= 0.5
    for c in attacks:
        quiet = quiet & (F.col(c) <= 0.5)
    df = df.withColumn("normal", F.when(quiet, 1.0).otherwise(F.col("normal")))
    order = [*labels, "anomaly"]
    first = F.coalesce(*[F.when(F.col(c) > 0.5, F.lit(c)) for c in order], F.lit(order[0]))
    highest = F.greatest(*[F.col(c) for c in order])
    df = df.withColumns(
        {
            "att_name": display_name(first),
            "is_hit": (highest > 0.5).cast("double"),
            "max_score": highest,
        }
    )
    return df.withColumn("result", result_code(F.col("att_name"), model_id)).drop(*order)


def mark_anomalies(df: DataFrame, threshold: float | Column, consistent_codes: bool = False):
    """Normal rows show the threshold as probs; scores above it are renamed ANOMALY.

    The code stays the one of the first label unless ``consistent_codes``.
    """
    threshold = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    above = F.col("anomaly_score") > threshold
    df = df.withColumn(
        "probs", F.when(F.col("att_name") == "NORMAL", threshold).otherwise(F.col("is_hit"))
    )
    df = df.withColumn("att_name", F.when(above, "ANOMALY").otherwise(F.col("att_name")))
    if consistent_codes:
        base = (F.floor(F.col("result") / 100) * 100).cast("bigint")
        df = df.withColumn("result", F.when(above, base + 5).otherwise(F.col("result")))
    return df


def result_rows(df: DataFrame, model_id: int, version: str) -> DataFrame:
    """The result table's columns in order, each row once."""
    filled = df.withColumns({n: F.lit(v) for n, v in RESULT_DEFAULTS.items()}).withColumns(
        {"model_id": F.lit(model_id).cast("bigint"), "feedback": F.lit(version)}
    )
    return filled.select(*RESULT_COLUMNS).dropDuplicates()


def as_text_copy(results: DataFrame) -> DataFrame:
    """The second copy of the results, probabilities as text."""
    return results.withColumn("probs", F.col("probs").cast("string"))


def _named_slot(slot: Sequence[str], start: int) -> tuple[Column, Column]:
    """Names and values of the entries whose places lie in a slot that begins at ``start``."""
    names = F.split(F.lit("\n".join(slot)), "\n")
    entries = F.arrays_zip("places", "weights")
    mine = F.filter(entries, lambda e: (e["places"] >= start) & (e["places"] < start + len(slot)))
    return F.transform(mine, lambda e: F.get(names, e["places"] - start)), F.transform(mine, lambda e: e["weights"])


def evidence_rows(scored: DataFrame, features, model_id: int, version: str) -> DataFrame:
    """For non-normal rows: per text column the names of the features a row has, and their values.

    ``features`` are the slots the sparse vectors were made with. Numbers have a column
    each. Features a row does not have are 0 and left out.
    """
    out = {
        "model_id": F.lit(model_id).cast("bigint"),
        "model_ver": F.lit(version),
        "http_host": F.array(F.lit("host")),
        "http_host_value": F.array(F.lit(0.0)),
    }
    start = len(features.numbers)
    for column, slot in features.slots.items():
        out[column], out[f"{column}_value"] = _named_slot(slot, start)
        start += len(slot)
    found = F.map_from_arrays("places", "weights")
    for n in STATUS_COLUMNS:
        out[n] = F.coalesce(F.element_at(found, F.lit(features.numbers.index(n))), F.lit(0.0))
    for column in ("http_agent", "http_query"):  # columns without a vocabulary have no features
        out.setdefault(column, F.array().cast("array<string>"))
        out.setdefault(f"{column}_value", F.array().cast("array<double>"))
    pairs = [c for t in ("http_host", "http_agent", "http_query") for c in (t, f"{t}_value")]
    return scored.where(F.col("att_name") != "NORMAL").withColumns(out).select(
        "model_id", "logtime", "end", "src_ip", "dst_ip", *STATUS_COLUMNS, *pairs,
        "model_ver", "att_name",
    )


def explained(df: DataFrame, values: str, weights: Column, names: Column) -> DataFrame:
    """Adds feature[] and score[]: weight times value less the row's median, highest first."""
    df = df.withColumn("_a", F.zip_with(values, weights, lambda v, w: v * w))
    df = df.withColumn("_m", array_median(F.col("_a")))
    centred = F.transform("_a", lambda a: a - F.col("_m"))
    df = df.withColumn("_p", by_score(names, centred))
    return df.withColumns({"feature": F.col("_p.feature"), "score": F.col("_p.score")}).drop(
        "_a", "_m", "_p"
    )


def median_with_zeros(values: Column, size: int) -> Column:
    """Median of the values and as many zeros as ``size`` numbers need."""
    ordered = F.sort_array(values)
    below = F.size(F.filter(values, lambda v: v < 0))
    zeros = F.lit(size) - F.size(values)

    def at(place: int) -> Column:
        here = F.lit(place)
        return F.when(here < below, F.get(ordered, here)).when(here < below + zeros, 0.0).otherwise(F.get(ordered, here - zeros))

    return (at((size - 1) // 2) + at(size // 2)) / 2


def explanation_rows(scored: DataFrame, bundle, model_id: int) -> DataFrame:
    """Explanations of all rows a specialist scored, with its own weights.

    A feature's score is its weight times its value less the row's median over all
    features. Features a row does not have share the score ``rest`` and are left out.
    """
    names = F.split(F.lit("\n".join(bundle.features.names)), "\n")
    parts = F.lit(None).cast("array<double>")
    for name, model in bundle.specialists.items():
        parts = F.when(F.col("route") == name, times_constant(model.weights)).otherwise(parts)
    rows = scored.where(F.col("route").isin(*bundle.specialists)).withColumn("_a", parts)
    rows = rows.withColumn("_m", median_with_zeros(F.col("_a"), len(bundle.features.names)))
    own = F.transform("places", lambda p: F.get(names, p))
    rows = rows.withColumn("_p", by_score(own, F.transform("_a", lambda a: a - F.col("_m"))))
    return rows.select(
        F.lit(model_id).cast("bigint").alias("model_id"),
        F.lit(bundle.version).alias("version"),
        "logtime", "src_ip", "dst_ip",
        F.col("_p.feature").alias("feature"), F.col("_p.score").alias("score"), (-F.col("_m")).alias("rest"),
        lookup(F.col("route"), DISPLAY_NAMES).alias("prediction"),
    )
