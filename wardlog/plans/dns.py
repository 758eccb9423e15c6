"""DNS profiles per address and hour, and of whole address sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions.text import url_chars
from wardlog.functions.times import monday_first, start_of
from wardlog.functions.vectors import class_c
from wardlog.operators.joins import flag_listed, with_one_row
from wardlog.operators.profiles import (
    VALUE,
    Profiles,
    counted,
    digest_of,
    digest_sums,
    from_counts,
    hour_ratios,
    running_sums,
    share_of,
    times,
    value_spread,
    weekday_ratios,
    with_hashes,
)

CLOCK = [f"hour_{h}" for h in range(24)] + [f"day_{d}" for d in range(1, 8)]


def with_intel(log: DataFrame, domains: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds 1/0 flags: the domain is listed, the address's /24 range is listed."""
    listed = ranges.select(class_c(F.col("range_start")).alias("ip_range"))
    out = flag_listed(log, domains, "dns_query", "target", "global_osint")
    out = out.withColumn("ip_range", class_c(F.col("src_ip")))
    return flag_listed(out, listed, "ip_range", "ip_range", "global_range")


def clock_ratios() -> dict:
    return {**hour_ratios(), **weekday_ratios()}


# Hour, weekday and intel flags of an event in one short value, such as "07-3-1-0".
CLOCK_AND_INTEL = "clock"


def clock_and_intel() -> Column:
    hour = F.lpad(F.hour("logtime").cast("string"), 2, "0")
    return F.concat_ws("-", hour, monday_first(F.col("logtime")).cast("string"), *[F.col(c).cast("string") for c in ("global_osint", "global_range")])


def place(start: int, size: int) -> Column:
    return F.substring(VALUE, start, size)


def dns_sums() -> dict[str, Column]:
    """Events and intel hits, added up from the counted values."""
    return {
        "cnt": times(CLOCK_AND_INTEL),
        "global_osint": times(CLOCK_AND_INTEL, place(6, 1) == "1"),
        "global_range": times(CLOCK_AND_INTEL, place(8, 1) == "1"),
    }


def hit_shares(sums: Mapping[str, Column]) -> dict[str, Column]:
    return {"cnt": sums["cnt"], **{c: sums[c] / sums["cnt"] for c in ("global_osint", "global_range")}}


def dns_folds(clock: bool = True) -> dict[str, Column]:
    """Counts, intel hit rates and clock shares, measured on the counted values."""
    out = hit_shares(dns_sums())
    if clock:
        out |= {f"hour_{h}": share_of(CLOCK_AND_INTEL, place(1, 2) == f"{h:02d}") for h in range(24)}
        out |= {f"day_{d}": share_of(CLOCK_AND_INTEL, place(4, 1) == str(d)) for d in range(1, 8)}
    return out


DNS_TEXTS = ("dns_query", "dns_answer")


def dns_counts(log: DataFrame, domains: DataFrame, ranges: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """Clock, intel flags and cleaned query and answer texts, counted per key.

    Where keys have ``few`` rows of the same text, texts are cleaned first and counted once.
    """
    rows = with_intel(log, domains, ranges)
    values = {CLOCK_AND_INTEL: clock_and_intel(), **{c: url_chars(F.col(c)) if few else F.col(c) for c in DNS_TEXTS}}
    clean = None if few else {c: url_chars for c in DNS_TEXTS}
    return counted(rows, keys, values, {"end_time": F.max("end_time")}, clean)


def dns_profile_of(counts: DataFrame, keys: Sequence[str], clock: bool = True) -> Profiles:
    return from_counts(counts, keys, {c: False for c in DNS_TEXTS}, dns_folds(clock), ["end_time"])


def running_dns(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures of each key's events up to each place, without clock shares."""
    sums = dns_sums()
    measures = hit_shares({n: F.col(n) for n in sums})
    for c in DNS_TEXTS:
        sums |= digest_sums(c)
        measures |= digest_of(c)
    out = running_sums(with_hashes(counts, DNS_TEXTS), keys, sums, ["end_time"])
    return out.select(*keys, "end_time", *[c.alias(n) for n, c in measures.items()])


def dns_profile(log: DataFrame, domains: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("lgtime", "src_ip")) -> Profiles:
    """Per (hour, address): counts, clock shares, intel hit rates, query and answer texts."""
    rows = log.withColumn("lgtime", start_of("hour", F.col("logtime")))
    return dns_profile_of(dns_counts(rows, domains, ranges, list(keys)), list(keys))


def rareness(log: DataFrame, wanted: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean share of all queries that ask for the domains the wanted addresses ask for.

    The wanted rows and the whole log are both folded to counts per domain, so
    the join is between two small tables and no row pairs are made.
    """
    whole = log.groupBy("dns_query").agg(F.count(F.lit(1)).alias("n"))
    total = whole.agg(F.sum("n")).scalar()
    mine = wanted.groupBy("dns_query", *groups).agg(F.count(F.lit(1)).alias("m"))
    met = mine.join(whole, "dns_query")
    mean = F.sum(F.col("m") * (F.col("n") / total)) / F.sum("m")
    return met.groupBy(*groups).agg(mean.alias("rareness"))


def hit_rates(wanted: DataFrame, domains: DataFrame, ranges: DataFrame, groups: Sequence[str] = ()):
    """Intel hit rates, averaged per /24 range and then over the ranges alike."""
    rows = wanted.groupBy("src_ip", "dns_query", *groups).agg(F.count(F.lit(1)).alias("n"))
    rows = with_intel(rows, domains, ranges)
    flags = ["global_osint", "global_range"]
    per_range = rows.groupBy("ip_range", *groups).agg(
        *[(F.sum(F.col(f) * F.col("n")) / F.sum("n")).alias(f) for f in flags]
    )
    return per_range.groupBy(*groups).agg(*[F.avg(f).alias(f) for f in flags])


def group_profile(
    log: DataFrame,
    wanted: DataFrame,
    domains: DataFrame,
    ranges: DataFrame,
    groups: Sequence[str] = (),
) -> DataFrame:
    """One profile per address set: count, clock shares, query spread, rareness, hit rates.

    With ``groups`` there is a row per batch of addresses, otherwise one row.
    """
    groups = list(groups)
    clock = wanted.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cnt"), *[c.alias(n) for n, c in clock_ratios().items()]
    )
    spread = value_spread(wanted, groups, {"dns_query": F.col("dns_query")})
    others = [
        spread.drop("dns_query_kinds"),
        rareness(log, wanted, groups),
        hit_rates(wanted, domains, ranges, groups),
    ]
    for part in others:
        clock = clock.join(part, groups, "left") if groups else with_one_row(clock, part)
    return clock


def mean_group_profile(profiles: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The mean of the batches' profiles, each batch counting the same."""
    names = [c for c in profiles.columns if c not in groups]
    return profiles.agg(*[F.avg(c).alias(c) for c in names])
