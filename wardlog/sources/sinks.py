"""Result tables: schemas, derived columns and day-partitioned writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog.functions.times import day_number
from wardlog.operators.joins import any_match
from wardlog.operators.ordering import last_by

SCHEMAS = {
    "history": """
        model_id bigint, start_time timestamp_ntz, end_time timestamp_ntz, accuracy double,
        positive_samples bigint, negative_samples bigint, total_samples bigint,
        epochs bigint, loss double, training_time double,
        logtime timestamp_ntz, logdate int, hash string
    """,
    "result": """
        model_id bigint, start_time timestamp_ntz, end_time timestamp_ntz, src_ip string,
        dst_ip string, dst_port bigint, result double, probs double, feedback string,
        packet smallint, hash string, logtime timestamp_ntz, logdate int
    """,
    "cluster": """
        model_id bigint, x double, y double, z double, result double,
        logtime timestamp_ntz, logdate int
    """,
    "feedback": """
        model_id bigint, feedback_time timestamp_ntz, start_time timestamp_ntz,
        end_time timestamp_ntz, src_ip string, dst_ip string, result double,
        feedback double, hash string, logtime timestamp_ntz, logdate int
    """,
}
# Per table: the time its rows are filed under and the columns its id is made of.
FILED_BY = {
    "history": ("start_time", ["model_id", "logtime", "accuracy"]),
    "result": ("start_time", ["model_id", "logtime", "src_ip", "dst_ip", "result"]),
    "cluster": ("logtime", []),
    "feedback": ("feedback_time", []),
}
DEFAULTS = {"result": {"feedback": "-", "packet": 0}}
SECOND = "yyyy-MM-dd HH:mm:ss"


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(SCHEMAS[table].split()))


def row_id(columns: Sequence[str], times: Sequence[str] = ("logtime",)) -> Column:
    """The same text id on every engine and every run."""
    parts = [
        F.date_format(c, SECOND) if c in times else F.col(c).cast("string") for c in columns
    ]
    return F.md5(F.concat_ws("|", *parts))


def with_derived(df: DataFrame, table: str) -> DataFrame:
    """Adds logtime, logdate and, where the table has one, the row id."""
    filed, id_columns = FILED_BY[table]
    needed = {filed, *id_columns} - {"logtime"}
    if needed - set(df.columns):
        raise ValueError(f"{table} needs columns {sorted(needed - set(df.columns))}")
    df = df.withColumn("logtime", F.col(filed)).withColumn("logdate", day_number(F.col("logtime")))
    return df.withColumn("hash", row_id(id_columns)) if id_columns else df


def in_table_order(df: DataFrame, table: str) -> DataFrame:
    """All columns of the table by name, cast; missing ones take their default."""
    defaults = DEFAULTS.get(table, {})
    out = []
    for field in schema_of(table):
        if field.name in df.columns:
            c = F.col(field.name)
        elif field.name in defaults:
            c = F.lit(defaults[field.name])
        else:
            raise ValueError(f"{table} needs a column {field.name}")
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def write_by_day(
    df: DataFrame,
    path: str,
    mode: str = "append",
    day: str = "logdate",
    order: str = "logtime",
    max_records: int | None = None,
) -> None:
    """Day folders, rows in time order inside each file.

    Rows are rebalanced by day: small days share a task and end up in one file
    each, and a day larger than the advisory size is split over several tasks.
    """
    shaped = df.hint("rebalance", day)
    writer = shaped.sortWithinPartitions(day, order).write.mode(mode).partitionBy(day)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)


def create_tables(spark: SparkSession, root: str, tables: Sequence[str] = tuple(SCHEMAS)) -> None:
    """Empty tables where none exist yet."""
    for table in tables:
        empty = spark.createDataFrame([], schema_of(table))
        empty.write.mode("ignore").partitionBy("logdate").parquet(f"{root}/{table}")


def append_rows(df: DataFrame, root: str, table: str, **shape) -> None:
    rows = in_table_order(with_derived(df, table), table)
    write_by_day(rows, f"{root}/{table}", **shape)


def read_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(schema_of(table)).parquet(f"{root}/{table}")


def write_snapshot(df: DataFrame, root: str, version: str) -> DataFrame:
    """Stores the data of one model version and returns it as read back."""
    path = f"{root}/model_ver={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/model_ver={version}")


def training_history(metrics: DataFrame, scores: DataFrame) -> DataFrame:
    """The last epoch of each class with its scores; 0 where it was never scored."""
    last = last_by(metrics, ["model_id", "attack_name"], "epochs").drop("accuracy")
    names = ["train_cnt", "test_cnt", "accuracy", "recall", "precision", "f1_score"]
    defaults = {n: 0 if n.endswith("cnt") else 0.0 for n in names}
    return any_match(last, scores.select("attack_name", *names), "attack_name", defaults)
