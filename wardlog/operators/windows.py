"""Aggregates of time windows over nested grains.

Windows of one key overlap, and rows should not be read again for each of them. So rows
are folded once per (key, hour), and hours once per (key, day). A window takes the days
that lie in it whole, of the other days the hours that do, and compares single rows only
in the hours its ends cut. A grain lies in a window if it begins no earlier and no row of
it ends later; a row that outlasts its hour makes that hour an edge.

Of windows that begin with an hour, each one's rows in that hour are also in those that
end later. There rows and windows get a place in the order of their ends, and no row is
compared with a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlog.functions.times import start_of
from wardlog.session import stored

WINDOW = ("window_start", "window_end")
# How many windows of its (key, hour) end before a row or stand before a window, and how many there are.
PLACE, PLACES = "place", "places"
# rows and keys to a row, or several, a key
Fold = Callable[[DataFrame, Sequence[str]], DataFrame]


def asked_windows(windows: DataFrame, key: str) -> DataFrame:
    """(key, window_start, window_end): each different window that can hold a row."""
    asked = windows.select(key, F.col("start_time").alias("window_start"), F.col("end_time").alias("window_end"))
    return stored(asked.where("window_start <= window_end").distinct(), "windows")


def bounded(log: DataFrame, asked: DataFrame, key: str, log_start: str, log_end: str) -> DataFrame:
    """Rows of the windows' keys between the first start and the last end, with their hour."""
    first, last = asked.agg(F.min("window_start")).scalar(), asked.agg(F.max("window_end")).scalar()
    rows = log.where((F.col(log_start) >= first) & (F.col(log_end) <= last))
    return rows.join(asked.select(key).distinct(), key, "left_semi").withColumn("_hour", start_of("hour", F.col(log_start)))


def cut(asked: DataFrame, days: DataFrame | None, hours: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows with the days, the hours and the edge hours they take.

    ``days`` and ``hours`` tell the ``last`` end of the rows of a key's grain. Grains
    without rows are left out; without ``days`` windows are cut into hours only.
    """
    unit = lambda name, c: start_of(name, F.col(c))
    every = lambda first, last, step: F.explode(F.sequence(first, last, F.expr(f"interval 1 {step}")))
    inside = lambda grain: (F.col(grain) >= F.col("window_start")) & (F.col("last") <= F.col("window_end"))
    if days is None:
        wanted, whole_days = asked.withColumn("_hour", every(unit("hour", "window_start"), unit("hour", "window_end"), "hour")), None
    else:
        met = asked.withColumn("_day", every(unit("day", "window_start"), unit("day", "window_end"), "day")).join(days, [key, "_day"])
        met = met.withColumn("_whole", inside("_day"))
        whole_days = met.where("_whole").select(key, *WINDOW, "_day")
        in_day = every(F.col("_day"), F.col("_day") + F.expr("interval 23 hours"), "hour")
        wanted = met.where("not _whole").select(key, *WINDOW, in_day.alias("_hour"))
        wanted = wanted.where((F.col("_hour") >= unit("hour", "window_start")) & (F.col("_hour") <= F.col("window_end")))
    met = wanted.join(hours, [key, "_hour"]).withColumn("_whole", inside("_hour")).select(key, *WINDOW, "_hour", "_whole")
    return whole_days, met.where("_whole").drop("_whole"), met.where("not _whole").drop("_whole")


def edge_rows(rows: DataFrame, edges: DataFrame, key: str, log_start: str, log_end: str) -> DataFrame:
    """Rows of the edge hours that lie in the window."""
    inside = (F.col(log_start) >= F.col("window_start")) & (F.col(log_end) <= F.col("window_end"))
    return rows.join(edges, [key, "_hour"]).where(inside)


def by_window_hour(
    log: DataFrame, windows: DataFrame, fold: Fold, key: str = "src_ip", log_start: str = "logtime", log_end: str = "end_time"
) -> DataFrame:
    """What ``fold`` gives for each (key, window_start, window_end, lgtime): the hours of each window.

    Hours that lie in a window whole are folded once for all windows.
    """
    asked = asked_windows(windows, key)
    rows = bounded(log, asked, key, log_start, log_end)
    hours = stored(rows.groupBy(key, "_hour").agg(F.max(log_end).alias("last")), "hours")
    _, whole, edges = cut(asked, None, hours, key)
    wanted = rows.join(whole.select(key, "_hour").distinct(), [key, "_hour"], "left_semi")
    shared = fold(wanted.withColumnRenamed("_hour", "lgtime"), [key, "lgtime"])
    shared = shared.join(whole.withColumnRenamed("_hour", "lgtime"), [key, "lgtime"])
    own = edge_rows(rows, edges, key, log_start, log_end).withColumnRenamed("_hour", "lgtime")
    own = fold(own, [key, *WINDOW, "lgtime"])
    return own.unionByName(shared.select(*own.columns))


def by_window(
    log: DataFrame, windows: DataFrame, fold: Fold, merge: Fold, key: str = "src_ip", log_start: str = "logtime", log_end: str = "end_time"
) -> DataFrame:
    """What ``fold`` gives for the rows of each (key, window_start, window_end).

    ``merge`` folds results of ``fold`` for parts of a key's rows into one for all of them.
    """
    asked = asked_windows(windows, key)
    rows = bounded(log, asked, key, log_start, log_end)
    spans = rows.groupBy(key, "_hour").agg(F.max(log_end).alias("last"))
    hours = stored(fold(rows, [key, "_hour"]).join(spans.withColumnRenamed("last", "_last"), [key, "_hour"]), "hours")
    daily = hours.withColumn("_day", start_of("day", F.col("_hour")))
    days = merge(daily.drop("_hour", "_last"), [key, "_day"])
    ends = daily.groupBy(key, "_day").agg(F.max("_last").alias("last"))
    whole_days, whole, edges = cut(asked, ends, hours.select(key, "_hour", F.col("_last").alias("last")).distinct(), key)
    found = [
        whole_days.join(days, [key, "_day"]).drop("_day"),
        whole.join(hours.drop("_last"), [key, "_hour"]).drop("_hour"),
        fold(edge_rows(rows, edges, key, log_start, log_end), [key, *WINDOW]),
    ]
    columns = found[-1].columns
    parts = found[0].select(*columns)
    for other in found[1:]:
        parts = parts.unionByName(other.select(*columns))
    return merge(parts, [key, *WINDOW])


def first_hours(
    log: DataFrame, windows: DataFrame, key: str = "src_ip", log_start: str = "logtime", log_end: str = "end_time"
) -> tuple[DataFrame, DataFrame]:
    """Log rows of the hours that windows begin with, and those windows, with their ``lgtime`` and places.

    A window has the rows of its first hour whose place is not above its own. Rows of the
    hour that end after all its windows are there too, with the number of places as theirs.
    Rows without an end and windows that do not begin with an hour are left out. The log is
    read once if the rows are; a task sorts the rows of a key's hour.
    """
    start, own = F.col("start_time"), [c for c in windows.columns if c not in (key, "start_time", "end_time")]
    asked = windows.where(F.col(key).isNotNull() & (start == start_of("hour", start)) & (start <= F.col("end_time")))
    asked = stored(asked.select(key, start.alias("lgtime"), F.col("end_time").alias("window_end"), *own), "windows")
    hours = stored(asked.groupBy(key, "lgtime").agg(F.count(F.lit(1)).alias(PLACES)), "hours")
    first, last = hours.agg(F.min("lgtime")).scalar(), hours.agg(F.max("lgtime")).scalar()
    rows = log.where((F.col(log_start) >= first) & (F.col(log_start) < last + F.expr("interval 1 hour")) & F.col(log_end).isNotNull())
    rows = rows.withColumn("lgtime", start_of("hour", F.col(log_start))).join(hours, [key, "lgtime"])
    both = rows.withColumns({"_end": F.col(log_end), "_window": F.lit(0)}).unionByName(
        asked.select(key, "lgtime", F.col("window_end").alias("_end"), F.lit(1).alias("_window")), allowMissingColumns=True
    )
    # rows stand before the windows that end with them
    hour = Window.partitionBy("lgtime", key)
    before = hour.orderBy("_end", "_window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(PLACE, F.sum("_window").over(before)).where("_window = 0").drop("_end", "_window")
    place = F.row_number().over(hour.orderBy("window_end", *own)) - 1
    return found, asked.withColumn(PLACE, place.cast("bigint"))
