"""Membership, lookup and interval joins.

No join carries a broadcast hint: the optimiser broadcasts a side only when its
known or measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise shuffles, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions.times import day_number, start_of


def _keys(listed: DataFrame, list_key: str, key: str) -> DataFrame:
    return listed.select(F.col(list_key).alias(key)).where(F.col(key).isNotNull()).distinct()


def drop_listed(rows: DataFrame, listed: DataFrame, key: str, list_key: str | None = None):
    """Rows whose key is not in the list; a NULL in the list changes nothing."""
    return rows.join(_keys(listed, list_key or key, key), key, "left_anti")


def keep_listed(rows: DataFrame, listed: DataFrame, key: str, list_key: str | None = None):
    return rows.join(_keys(listed, list_key or key, key), key, "left_semi")


def in_either(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found in one source or the other."""
    return left.select(key).join(right.select(key), key, "full_outer")


def any_match(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    defaults: Mapping[str, object],
    order: Sequence[str] = (),
) -> DataFrame:
    """Left join that keeps one match per key; rows without one get the defaults.

    The match kept is the smallest by ``order``, then by the other columns.
    """
    on = [on] if isinstance(on, str) else list(on)
    names = list(defaults)
    ranked = [*order, *[n for n in names if n not in order]]
    one = right.groupBy(*on).agg(F.min(F.struct(*ranked)).alias("_match"))
    one = one.select(*on, *[F.col("_match")[n].alias(n) for n in names])
    joined = left.join(one, on, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in defaults.items()})


def flag_listed(rows: DataFrame, listed: DataFrame, key: str, list_key: str, flag: str):
    """Adds ``flag``: 1 where the key is in the list, else 0."""
    marked = _keys(listed, list_key, key).withColumn(flag, F.lit(1))
    return rows.join(marked, key, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def members_of_windows(
    log: DataFrame,
    windows: DataFrame,
    key: str = "src_ip",
    log_start: str = "logtime",
    log_end: str = "end_time",
) -> DataFrame:
    """Log rows inside each (key, start_time, end_time) window.

    Equal windows are joined once. Windows are cut into hours and the join is on
    (key, hour), so one busy key is spread over the hours it was active and a row
    meets only windows of its hour. The log is first bounded by the first start and
    the last end, which are taken once as scalar subqueries.
    """
    asked = windows.select(key, "start_time", "end_time").where(F.col("start_time") <= F.col("end_time"))
    hour = lambda c: start_of("hour", F.col(c))
    cut = (
        asked.distinct()
        .withColumnsRenamed({"end_time": "window_end", "start_time": "window_start"})
        .withColumn(
            "_hour", F.explode(F.sequence(hour("window_start"), hour("window_end"), F.expr("interval 1 hour")))
        )
    )
    first, last = asked.agg(F.min("start_time")).scalar(), asked.agg(F.max("end_time")).scalar()
    inside = (F.col(log_start) >= F.col("window_start")) & (F.col(log_end) <= F.col("window_end"))
    return (
        log.where((F.col(log_start) >= first) & (F.col(log_end) <= last))
        .withColumn("_hour", hour(log_start))
        .join(cut, [key, "_hour"])
        .where(inside)
        .drop("_hour")
    )


def members_of_stored_days(log: DataFrame, windows: DataFrame, day: str = "logdate", key: str = "src_ip", **columns) -> DataFrame:
    """Members of windows in a log stored in folders by ``day`` (yyyyMMdd of the row's start).

    The windows' days are joined to the folder column, so that Spark prunes the folders by
    the days it finds while the query runs.
    """
    one = F.expr("interval 1 day")
    days = F.explode(F.sequence(start_of("day", F.col("start_time")), start_of("day", F.col("end_time")), one))
    asked = windows.where("start_time <= end_time").select(days.alias("_start")).select(day_number(F.col("_start")).alias(day)).distinct()
    return members_of_windows(log.join(asked, day, "left_semi"), windows, key, **columns)


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame to every row; NULLs where it has no row.

    The row is a scalar subquery, so it is computed once and nothing is joined.
    """
    row = one.select(F.struct(*one.columns).alias("row")).scalar()
    return df.withColumns({c: row[c] for c in one.columns})


def share_of_total(df: DataFrame, count: str | Column, name: str = "share") -> DataFrame:
    """Each row's count over the sum of all, the sum taken once as a scalar subquery."""
    count = F.col(count) if isinstance(count, str) else count
    total = df.agg(F.sum(count)).scalar()
    return df.withColumn(name, F.try_divide(count.cast("double"), total))
