"""Reading log tables, the version list and the model registry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.operators.ordering import union_all

CONFIG_FIELDS = {
    "now_delta": "string",
    "prev_delta": "string",
    "crontab": "string",
    "data_limit": "bigint",
    "vector_size": "int",
    "n_grams_lower": "int",
    "n_grams_upper": "int",
}


def read_window(spark: SparkSession, path: str, ts: str, start: str, end: str) -> DataFrame:
    """A time slice of a table; the bounds reach the file scan."""
    rows = spark.read.parquet(path)
    kind = rows.schema[ts].dataType.simpleString()
    return rows.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def from_sources(spark: SparkSession, paths: Mapping[str, str], tag: str = "source_name"):
    """The same table from several places, each row tagged with its place."""
    return union_all(
        [spark.read.parquet(p).withColumn(tag, F.lit(name)) for name, p in paths.items()]
    )


def stored_columns(df: DataFrame, derived: Iterable[str] = ()) -> list[str]:
    hidden = set(derived)
    return [c for c in df.columns if c not in hidden]


def labelled(rows: DataFrame, label: str, labels: Mapping[str, str], name: str = "label"):
    """Rows of the listed classes with their class name: one scan for all classes."""
    pairs = [F.lit(v) for pair in labels.items() for v in pair]
    found = F.element_at(F.create_map(*pairs), F.col(label))
    return rows.where(F.col(label).isin(*labels)).withColumn(name, found)


def latest_version(versions: DataFrame, now: str, column: str = "model_ver") -> DataFrame:
    """The newest version not after ``now``; both are YYYY_MM_DD_HH_MM texts."""
    return versions.where(F.col(column) <= now).agg(F.max(column).alias(column))


def require_version(versions: DataFrame, now: str, column: str = "model_ver") -> str:
    found = latest_version(versions, now, column).first()[0]
    if found is None:
        raise LookupError(f"no model version up to {now}")
    return found


def run_config(registry: DataFrame, branch: str, model_id: int | Column | None = None):
    """Registry rows with the train or predict branch of their JSON configuration."""
    fields = ", ".join(f"{name}: {kind}" for name, kind in CONFIG_FIELDS.items())
    branch_type = f"struct<{fields}>"
    schema = f"train {branch_type}, predict {branch_type}"
    if model_id is not None:
        registry = registry.where(F.col("model_id") == model_id)
    cfg = F.from_json("config", schema)
    return registry.select("model_id", "model_name", cfg[branch].alias("cfg")).select(
        "model_id", "model_name", "cfg.*"
    )
