"""Time expressions over zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"

UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
DAY_SECONDS = 86400


def start_of(unit: str, c: Column) -> Column:
    """Start of the minute, 5minute, 15minute, hour, day, month, quarter or year."""
    if unit in ("5minute", "15minute"):
        minutes = int(unit[:-6])
        late = F.minute(c) % minutes
        minute = F.date_trunc("minute", c)
        return (minute - F.make_dt_interval(mins=late)).cast(NTZ)
    return F.date_trunc(unit, c).cast(NTZ)


def cron_unit(crontab: Column) -> Column:
    """The truncation unit a five-field cron text asks for; ``hour`` if unclear."""
    fields = F.split(crontab, " ")
    field = [F.get(fields, F.lit(i)) for i in range(5)]
    unit = (
        F.when((field[0] == "*/1") | (crontab == "* * * * *"), "minute")
        .when(field[0] == "*/5", "5minute")
        .when(field[0] == "*/15", "15minute")
        .when(field[1] == "*/1", "hour")
        .when(field[2] == "*/1", "day")
        .when(field[2] == "*/4", "quarter")
        .when(field[3] == "*/1", "month")
        .when(field[4] == "*/1", "year")
        .otherwise("hour")
    )
    return F.when(F.size(fields) == 5, unit).otherwise("hour")


def duration_seconds(c: Column) -> Column:
    """Seconds of a ``unit=n`` text; one day where it cannot be read."""
    unit = F.substring_index(c, "=", 1)
    number = F.regexp_extract(c, "^[a-z]+=(-?[0-9]+)$", 1).try_cast("bigint")
    factor = F.lit(None).cast("bigint")
    for name, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == name, F.lit(seconds).cast("bigint")).otherwise(factor)
    return F.coalesce(number * factor, F.lit(DAY_SECONDS).cast("bigint"))


def shift(c: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return (c.cast("timestamp") + F.make_dt_interval(secs=seconds)).cast(NTZ)


def day_start(d: str | Column, days: int = 0) -> Column:
    """Midnight ``days`` after the date."""
    d = F.lit(d).cast("date") if isinstance(d, str) else d.cast("date")
    return F.date_add(d, days).cast(NTZ)


def at(text: str) -> Column:
    return F.lit(text).cast(NTZ)


def day_number(c: Column) -> Column:
    """yyyyMMdd as a number."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def monday_first(c: Column) -> Column:
    """Day of the week, Monday = 1."""
    return F.weekday(c) + 1


def run_window(df, now: str, now_delta: str, prev_delta: str, zone_hours: int = 9):
    """Adds the parameters of a scheduled run to each row that carries its configuration."""
    end = shift(F.col(now), F.lit(zone_hours * 3600) - duration_seconds(F.col(now_delta)))
    df = df.withColumn("logtime_e", end)
    df = df.withColumn("logtime_s", shift(F.col("logtime_e"), -duration_seconds(F.col(prev_delta))))
    day = "yyyy-MM-dd"
    return df.withColumns(
        {
            "logdate_s": F.date_format("logtime_s", day),
            "logdate_e": F.date_format("logtime_e", day),
            "logdate_m": F.date_format(shift(F.col("logtime_e"), -8 * UNIT_SECONDS["weeks"]), day),
            "logdate_day": F.date_format(shift(F.col("logtime_e"), -DAY_SECONDS), day),
        }
    )
