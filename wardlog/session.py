"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wardlog", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session zone and let shuffles start as wide as the cluster is.

    All log times are wall-clock UTC. Shuffles begin with three partitions per
    core unless the session says otherwise, and are merged at run time where
    the data is small.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(PARTITIONS, None) is None:
        configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set(PARTITIONS, str(max(configured, 3 * cores)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a fresh one where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    base = tempfile.mkdtemp(prefix="wardlog-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, without the plan that made them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    For rows that are dear to find and read more than once.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path nothing has written to yet, under the shared folder."""
    return f"{shared_dir(spark)}/wardlog/{name}-{uuid.uuid4().hex}"
