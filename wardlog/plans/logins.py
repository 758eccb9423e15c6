"""Login profiles, DNS profiles and the enrichment of address profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.constants import LOGIN_CODES
from wardlog.operators.joins import any_match, flag_listed, keep_listed
from wardlog.operators.ordering import gap_statistics
from wardlog.operators.predicates import in_days, on_day
from wardlog.operators.profiles import (
    login_outcomes,
    service_counts,
    with_service_ratios,
)

RATIOS = [f"{s}_{r}_ratio" for r in ("s", "f") for s in ("a", "h", "other")]
OUTCOMES = [f"{c}_{r}" for c in LOGIN_CODES for r in (0, 1)]


def day_rows(log: DataFrame, day: str, addresses: DataFrame | None = None) -> DataFrame:
    rows = log.where(on_day("logdate", day))
    return rows if addresses is None else keep_listed(rows, addresses, "client_ip")


def service_shares(log: DataFrame) -> DataFrame:
    return with_service_ratios(log.groupBy("client_ip").agg(
        *[c.alias(n) for n, c in service_counts().items()]
    ))


def login_profile(
    log: DataFrame, day: str | None = None, addresses: DataFrame | None = None
) -> DataFrame:
    """Service shares and the rhythm of log-ins per client, of one day and some clients if given."""
    if day is not None:
        log = day_rows(log, day, addresses)
    rhythm = gap_statistics(log, "client_ip", "logtime")
    shares = service_shares(log).select("client_ip", *RATIOS)
    out = any_match(rhythm, shares, "client_ip", {n: 0.0 for n in RATIOS})
    return out.select("client_ip", *RATIOS, "diff_avg", "diff_std")


def outcome_counts(log: DataFrame, day: str | None = None) -> DataFrame:
    """Log-ins per client, service code and outcome over the seven days before ``day``."""
    rows = log if day is None else log.where(in_days("logtime", day, -7, 0))
    return rows.groupBy("client_ip").agg(*[c.alias(n) for n, c in login_outcomes().items()])


def enriched(
    profiles: DataFrame,
    assets: DataFrame,
    outcomes: DataFrame,
    key: str = "src_ip",
    clear_asset_flag: bool = False,
) -> DataFrame:
    """Profiles with the asset flag and the ten log-in counters of their address.

    ``clear_asset_flag`` sets the flag to 0 where the only failures are A1000's.
    """
    out = flag_listed(profiles, assets, key, "ip", "asset")
    counters = outcomes.withColumnRenamed("client_ip", key).select(key, *OUTCOMES)
    out = out.join(counters, key, "left").na.fill(0, OUTCOMES)
    if clear_asset_flag:
        others = [F.col(f"{c}_1") == 0 for c in LOGIN_CODES if c != "A1000"]
        only = F.col("A1000_1") > 0
        for other in others:
            only = only & other
        out = out.withColumn("asset", F.when(only, 0).otherwise(F.col("asset")))
    return out
