"""The recurring jobs as Structured Streaming queries.

All run with ``availableNow``: each start takes what has arrived since the last one and
stops. Batches are folded to values that can be merged and kept as a merged base plus
the batches since (see ``state``), so a start reads neither the stream's earlier rows
nor more than some batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.ml.rarity import token_counts
from wardlog.operators.profiles import method_marks, status_marks
from wardlog.streaming.state import EVERY, MergedState, newest_by


def only(path: str) -> str:
    """A pattern for this path: a stream takes a single file in that form only.

    It matches nothing else, but for a path that ends in neither letter nor digit.
    """
    path = path.rstrip("/")
    escaped = "".join(f"\\{c}" if c in "*?{}[]\\" else c for c in path[:-1])
    return f"{escaped}[{path[-1]}]" if path[-1].isalnum() else f"{escaped}?"


def read_files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A parquet table (a file or a folder) as a stream, its schema taken from the files there now."""
    reader = spark.readStream.schema(spark.read.parquet(only(path)).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(only(path))


def run_batches(stream: DataFrame, state: MergedState, make: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """Adds each batch of the stream to the state, waits until all is written, and merges if it is time."""
    job = (
        stream.writeStream.outputMode("append")
        .foreachBatch(lambda batch, batch_id: state.write(make(batch), batch_id))
        .option("checkpointLocation", f"{state.path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    state.compact()


HOUR_KEYS = ["lgtime", "src_ip", "dst_ip"]


def hourly_parts(rows: DataFrame) -> DataFrame:
    """What one batch adds to the one-hour profile of each address pair: values that can be merged.

    Ports are kept as sets, of 65,536 at most.
    """
    marks = {**method_marks(), **status_marks()}
    start = F.date_trunc("hour", "end_time").cast("timestamp_ntz").alias("lgtime")
    return rows.groupBy(start, "src_ip", "dst_ip").agg(
        F.max("end_time").alias("end_time"),
        F.count(F.lit(1)).alias("cnt"),
        F.sort_array(F.collect_set("dst_port")).alias("ports"),
        F.sum("bytes_forward").alias("bytes"),
        *[F.count_if(mark).alias(name) for name, mark in marks.items()],
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts of the same key in one: as many as a base and the batches since, so their port sets are few."""
    sums = [c for c in parts.columns if c not in (*HOUR_KEYS, "end_time", "ports")]
    return parts.groupBy(*HOUR_KEYS).agg(
        F.max("end_time").alias("end_time"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("ports"),
        *[F.sum(c).alias(c) for c in sums],
    ).select(*parts.columns)


def profile_state(spark: SparkSession, path: str, every: int = EVERY) -> MergedState:
    return MergedState(spark, path, merged_parts, every)


def run_hourly_profile(stream: DataFrame, path: str, every: int = EVERY) -> DataFrame:
    """Adds the stream's batches to the stored parts and returns the profile over all of them.

    Parts are merged when read, so a row may come as late as it likes.
    """
    state = profile_state(stream.sparkSession, path, every)
    run_batches(stream, state, hourly_parts)
    return shown_profile(state.current())


def shown_profile(parts: DataFrame) -> DataFrame:
    marks = {**method_marks(), **status_marks()}
    return parts.select(
        *HOUR_KEYS, "end_time", "cnt", F.size("ports").cast("bigint").alias("ports"), "bytes",
        *[(F.col(n) / F.col("cnt")).alias(n) for n in marks],
    )


def run_scoring(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    count: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    every: int = EVERY,
) -> DataFrame:
    """Scores each key the stream's new rows touch on all its rows so far, and returns the scores of all keys.

    ``count`` folds log rows to counts with the columns ``keys``, ``merge`` adds such counts
    up, and ``score`` turns merged counts into one row a key; log rows are not kept. A
    start reads the base and the batches since, and writes scores filed by the last batch
    they cover, so a start that is repeated after a loss writes the same rows again.
    """
    spark, keys = stream.sparkSession, list(keys)
    counts = MergedState(spark, f"{path}/counts", merge, every)
    scores = MergedState(spark, f"{path}/scores", newest_by(keys, "upto"), every)
    run_batches(stream, counts, count)
    newest, done = counts.last(), scores.last()
    fresh = counts.rows(after=done)
    if fresh is not None and newest > done:
        named = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        touched = merge(counts.rows().join(named, same, "left_semi"))
        scores.write(score(touched).withColumn("upto", F.lit(newest)), newest)
        scores.compact()
    current = scores.current()
    return None if current is None else current.drop("upto")


def run_token_counts(
    stream: DataFrame,
    path: str,
    texts: Sequence[str] = (),
    numbers: Sequence[str] = (),
    groups: Sequence[str] = (),
    every: int = EVERY,
) -> DataFrame:
    """Adds each batch's token counts to the stored dictionary and returns it."""
    state = dictionary(stream.sparkSession, path, every)
    run_batches(stream, state, lambda b: token_counts(b, texts, numbers, groups))
    return state.current()


def added_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[c for c in rows.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt")).select(*rows.columns)


def dictionary(spark: SparkSession, path: str, every: int = EVERY) -> MergedState:
    """The stored token counts."""
    return MergedState(spark, path, added_counts, every)
