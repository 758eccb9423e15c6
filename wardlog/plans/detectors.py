"""Signature-driven and alert-driven detectors and the session-hijack detector."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.functions import text
from wardlog.functions.times import start_of
from wardlog.operators import predicates as P
from wardlog.operators.joins import drop_listed, keep_listed
from wardlog.operators.profiles import (
    Profiles,
    Texts,
    counted,
    entropy,
    from_counts,
    kinds,
    mean_bytes,
    method_ratios,
    method_shares,
    port_shares,
    profile,
    status_ratios,
    status_shares,
    times,
    traffic_moments,
    united,
)
from wardlog.session import stored

HOUR_KEYS = ["lgtime", "src_ip", "dst_ip"]
KEYWORDS = {
    "path": ("http_path", text.path_keywords),
    "query": ("http_query", text.query_keywords),
    "agent": ("http_agent", text.agent_keywords),
}
# Days around the run day each signature detector looks at.
DAY_WINDOWS = {1: (0, 31), 2: (-31, 31), 3: (0, 3), 4: (-31, 31), 5: (0, 2), 6: (0, 31)}
# Alerts an address needs beyond the base limit before its traffic is profiled.
ALERT_OFFSETS = {1: 150, 2: 50, 4: 500, 5: 5, 6: 40}
SPOOF_OFFSET = 10
HIJACK_HITS = 200
# What the traffic profiles read; nothing else of the picked rows is stored.
TRAFFIC_COLUMNS = [
    "lgtime", "end_time", "src_ip", "dst_ip", "http_method", "http_retcode", "bytes_forward",
    "bytes_backward", "packets_forward", "packets_backward",
]


def by_hour(log: DataFrame) -> DataFrame:
    return log.withColumn("lgtime", start_of("hour", F.col("logtime")))


def attack_profile(rows: DataFrame, keys: Sequence[str] = HOUR_KEYS, keep: Column | None = None) -> Profiles:
    """Methods, ports, keyword spread and the different keyword texts per key, off one count of values."""
    texts = {n: Texts(clean(F.col(c))) for n, (c, clean) in KEYWORDS.items()}
    spread = {"port": "dst_port", **{n: n for n in KEYWORDS}}
    requests = times("http_method")
    folds = {
        "cnt": F.length(requests.cast("string")).cast("bigint"),
        "requests": requests,
        **method_shares(),
        **port_shares(),
        **{f"{n}_uni": mean_bytes(n) for n in KEYWORDS},
        **{f"{n}_ent": entropy(c) for n, c in spread.items()},
        "uniq_dst_port": kinds("dst_port"),
    }
    values = {c: F.col(c) for c in ("http_method", "dst_port")}
    return profile(rows, keys, texts, folds, values, {"end_time": F.max("end_time")}, keep)


def traffic_numbers(
    rows: DataFrame, keys: Sequence[str] = HOUR_KEYS, bytes_too: bool = True, missing: str = ""
) -> DataFrame:
    """Traffic profile without texts: one partial aggregate."""
    measures = {
        "end_time": F.max("end_time"),
        "cnt": F.count(F.lit(1)),
        **method_ratios(),
        **(traffic_moments() if bytes_too else {}),
        **status_ratios(missing=missing),
    }
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


URL_TEXTS = ("http_host", "http_path", "http_query")


def traffic_counts(rows: DataFrame, keys: Sequence[str], bytes_too: bool = True, texts: Sequence[str] = URL_TEXTS) -> DataFrame:
    """Methods, status codes and cleaned texts, counted per key, with ends, bytes and packets."""
    values = {c: F.col(c) for c in ("http_method", "http_retcode")}
    values |= {c: text.url_chars(F.col(c)) for c in texts}
    whole = {"end_time": F.max("end_time"), "cnt": F.count(F.lit(1)), **(traffic_moments() if bytes_too else {})}
    return counted(rows, keys, values, whole)


def traffic_profile_of(
    counts: DataFrame, keys: Sequence[str], bytes_too: bool = True, missing: str = "", texts: Sequence[str] = URL_TEXTS
) -> Profiles:
    folds = {**method_shares(), **status_shares(missing=missing)}
    whole = ["end_time", "cnt", *(traffic_moments() if bytes_too else {})]
    return from_counts(counts, keys, {c: False for c in texts}, folds, whole)


def traffic_profile(
    rows: DataFrame,
    keys: Sequence[str] = HOUR_KEYS,
    bytes_too: bool = True,
    missing: str = "",
    texts: Sequence[str] = URL_TEXTS,
    keep: Column | None = None,
) -> Profiles:
    """Traffic profile with every cleaned host, path and query text."""
    out = traffic_profile_of(traffic_counts(rows, keys, bytes_too, texts), keys, bytes_too, missing, texts)
    return out if keep is None else out.with_measures(lambda m: m.where(keep))


def signature_rules() -> dict[int, Column]:
    return {
        1: P.file_probe(),
        2: P.injection(),
        3: P.spoofed(),
        4: P.scanner(),
        5: P.credential(),
        6: P.xss(),
    }


def signature_rows(
    log: DataFrame,
    assets: DataFrame,
    day: str,
    codes: Sequence[int] = tuple(DAY_WINDOWS),
    exclusions: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """One row per log row and signature it matches, from a single scan.

    The widest window of the wanted detectors is a filter on the raw time
    column, so only its days are read; each detector's own window comes on top.
    """
    rules = signature_rules()
    first = min(DAY_WINDOWS[c][0] for c in codes)
    last = max(DAY_WINDOWS[c][1] for c in codes)
    hits = [
        F.when(P.in_days("logtime", day, *DAY_WINDOWS[c]) & rules[c], F.lit(c)) for c in codes
    ]
    rows = log.where(P.in_days("logtime", day, first, last))
    if exclusions:
        rows = rows.where(~P.known_noise(exclusions))
    rows = rows.withColumn("code", F.explode(F.array_compact(F.array(*hits))))
    return by_hour(drop_listed(rows, assets, "src_ip", "ip"))


def signature_detector(
    log: DataFrame,
    assets: DataFrame,
    day: str,
    codes: Sequence[int] = tuple(DAY_WINDOWS),
    exclusions: Sequence[tuple[str, str]] = (),
    least: int = 10,
) -> Profiles:
    """Hourly attack profiles of the rows each detector picks."""
    rows = signature_rows(log, assets, day, codes, exclusions)
    often = (F.col("code") != 3) | (F.col("requests") >= least + SPOOF_OFFSET)
    return attack_profile(rows, ["code", *HOUR_KEYS], often if 3 in codes else None)


def alert_kinds() -> dict[int, tuple[Column, Column | None]]:
    """Detector code -> which block and which firewall alerts count for it."""
    name = F.col("attack_name")
    return {
        1: (P.attempt_or_vulnerability(), P.attempt_or_vulnerability()),
        2: (name.like("%SQL%"), name.like("%Inject%")),
        4: (name.like("%Scan%"), name.like("%Scan%")),
        5: (name.like("%HTTP%Brute Force%"), None),
        6: (name.like("%XSS%"), name.like("%XSS%")),
    }


def _loud(alerts: DataFrame, kinds: Mapping[int, Column], least: Mapping[int, int]) -> DataFrame:
    """Per address the codes with enough alerts, all counted in one pass."""
    counts = alerts.groupBy("src_ip").agg(
        *[F.count_if(named).alias(f"n{code}") for code, named in kinds.items()]
    )
    met = [F.when(F.col(f"n{code}") >= least[code], F.lit(code)) for code in kinds]
    codes = counts.select("src_ip", F.array_compact(F.array(*met)).alias("codes"))
    return codes.where(F.size("codes") > 0)


def alerted(block: DataFrame, waf: DataFrame, least: Mapping[int, int]) -> DataFrame:
    """Addresses with enough block or firewall alerts, and the codes they have them for."""
    kinds = {code: pair for code, pair in alert_kinds().items() if code in least}
    blocked = _loud(block, {c: b for c, (b, _) in kinds.items()}, least)
    walls = {c: w for c, (_, w) in kinds.items() if w is not None}
    if not walls:
        return blocked
    walled = _loud(waf, walls, least).withColumnRenamed("codes", "wall_codes")
    none = F.array().cast("array<int>")
    codes = F.concat(F.coalesce("codes", none), F.coalesce("wall_codes", none))
    both = blocked.join(walled, "src_ip", "full_outer")
    return both.select("src_ip", F.sort_array(F.array_distinct(codes)).alias("codes"))


def alert_detector(
    log: DataFrame,
    block: DataFrame,
    waf: DataFrame,
    assets: DataFrame,
    day: str,
    codes: Sequence[int] = (1, 2, 3, 4, 5, 6),
    least: int = 10,
    offsets: Mapping[int, int] = ALERT_OFFSETS,
    texts: Sequence[str] = URL_TEXTS,
) -> Profiles:
    """Hourly traffic profiles of alerted addresses, one row per code that names the address.

    An address's traffic is profiled once and only then repeated for its codes.
    Spoofing needs no alert: its rows are picked and profiled on their own.
    """
    rows = log.where(P.in_days("logtime", day, 0, 31))
    rows = by_hour(drop_listed(rows, assets, "src_ip", "ip"))
    found = []
    by_alert = {c: least + offsets[c] for c in codes if c != 3}
    if by_alert:
        named = stored(alerted(block, waf, by_alert), "alerted")
        loud = traffic_profile(keep_listed(rows, named, "src_ip"), texts=texts)
        coded = named.select("src_ip", F.explode("codes").alias("code"))
        tables = [table.join(coded, "src_ip") for table in (loud.rows, loud.texts)]
        found.append(Profiles(("code", *HOUR_KEYS), *tables, loud.columns))
    if 3 in codes:
        often = F.col("cnt") >= least + SPOOF_OFFSET
        spoofed = traffic_profile(rows.where(P.spoofed()), texts=texts, keep=often)
        found.append(spoofed.with_key("code", F.lit(3)))
    return united(found)


def hijack_candidates(
    log: DataFrame,
    start: str | None = None,
    hits: int = HIJACK_HITS,
    texts: Sequence[str] = ("http_path", "http_query", "http_cookie"),
) -> Profiles:
    """Addresses that sent many session requests to a single path within an hour.

    One path means zero entropy; smallest = largest tells it without a count.
    The groups are found first, and only their rows have texts gathered.
    """
    rows = log.where(P.has_session())
    if start:
        rows = rows.where(F.col("logtime") >= F.lit(start).cast("timestamp_ntz"))
    rows = by_hour(rows)
    keys = ["lgtime", "src_ip"]
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_hits"),
        (F.min("http_path") == F.max("http_path")).alias("_one_path"),
    ).where((F.col("_hits") > hits) & F.col("_one_path")).select(*keys)
    return traffic_profile(rows.join(found, keys, "left_semi"), keys, texts=texts)


def hijack_detector(log: DataFrame, assets: DataFrame, start: str | None = None, **options) -> Profiles:
    return hijack_candidates(drop_listed(log, assets, "src_ip", "ip"), start, **options)


def asset_lookup(addresses: DataFrame, assets: DataFrame, key: str = "src_ip") -> DataFrame:
    """The wanted addresses that are assets, each once."""
    return keep_listed(addresses.select(key).distinct(), assets, key, "ip").withColumn(
        "asset", F.lit(1)
    )
