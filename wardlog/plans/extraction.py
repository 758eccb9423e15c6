"""Training and prediction extractions from the HTTP log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.constants import TRAIN_LABELS
from wardlog.functions.text import payload_words
from wardlog.operators.joins import drop_listed
from wardlog.operators.ordering import cap_per_class, first_rows
from wardlog.operators.predicates import has_text, in_range, is_ipv4
from wardlog.operators.profiles import Profiles, added_counts, counted, from_counts, kinds, status_shares, united
from wardlog.session import stored
from wardlog.sources.tables import labelled

KEYS = ["logtime", "src_ip", "dst_ip"]
TEXTS = {"agent_": "http_agent", "query_": "http_query"}


def http_counts(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Ports, status codes and cleaned agent and query texts, counted per key; counts of batches add up."""
    values = {c: F.col(c) for c in ("dst_port", "http_retcode")} | {n: F.col(c) for n, c in TEXTS.items()}
    return counted(rows, keys, values, {"end": F.max("end_time")}, {n: payload_words for n in TEXTS})


def merged_http_counts(counts: DataFrame) -> DataFrame:
    return added_counts(counts, {"end": F.max})


def http_profile_of(counts: DataFrame, keys=KEYS, missing: str = "") -> Profiles:
    folds = {"dst_port_cnt": kinds("dst_port"), **status_shares(missing=missing)}
    return from_counts(counts, keys, {n: True for n in TEXTS}, folds, ["end"])


def http_profile(rows: DataFrame, keys=KEYS, missing: str = "", once: bool = False) -> Profiles:
    """Ports, status shares and the different cleaned agent and query texts per key.

    With ``once`` the counted values are written, so that the log is read once for callers
    that read measures and texts.
    """
    counts = http_counts(rows, keys)
    return http_profile_of(stored(counts, "counts") if once else counts, keys, missing)


def window_rows(log: DataFrame, start: str, end: str) -> DataFrame:
    return log.where(in_range("logtime", start, end) & has_text())


def first_keys(rows: DataFrame, limit: int | None) -> DataFrame:
    """The rows of the first keys only; picked before anything is profiled."""
    if limit is None:
        return rows
    return rows.join(first_rows(rows.select(*KEYS).distinct(), KEYS, limit), KEYS, "left_semi")


def prediction_rows(
    log: DataFrame, start: str, end: str, missing: str = "", limit: int | None = None, once: bool = False
) -> Profiles:
    """Profiles of a time range; with a limit, of its first keys only."""
    return http_profile(first_keys(window_rows(log, start, end), limit), KEYS, missing, once)


def normal_rows(log: DataFrame, start: str, end: str, limit: int | None = None, once: bool = False) -> Profiles:
    """Profiles of a time range, labelled normal; with a limit, of its first keys only."""
    rows = first_keys(window_rows(log, start, end), limit)
    return http_profile(rows, KEYS, once=once).with_key("label", F.lit("normal"))


def attack_rows(
    log: DataFrame, assets: DataFrame, limit: int | None = None, labels: Mapping[str, str] = TRAIN_LABELS, once: bool = False
) -> Profiles:
    """Profiles of the labelled attack classes, from one scan, capped per class."""
    rows = labelled(log.where(has_text() & is_ipv4()), "hash", labels)
    rows = drop_listed(rows, assets, "src_ip", "ip")
    keys = ["label", *KEYS]
    if limit is not None:
        wanted = cap_per_class(rows.select(*keys).distinct(), "label", KEYS, limit)
        rows = rows.join(wanted, keys, "left_semi")
    return http_profile(rows, keys, once=once)


def training_rows(log, assets, start: str, end: str, limit: int | None = None, once: bool = False) -> Profiles:
    return united([normal_rows(log, start, end, limit, once), attack_rows(log, assets, limit, once=once)])
