"""Training rows from analyst feedback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.ml.likeness import unlike
from wardlog.ml.slots import fit_slots, sparse
from wardlog.operators.joins import any_match
from wardlog.operators.predicates import reviewed
from wardlog.operators.profiles import Profiles, block_of, cell, listed, text_blocks, with_texts
from wardlog.operators.windows import PLACE, PLACES, by_window_hour, first_hours
from wardlog.plans.detectors import traffic_counts, traffic_numbers, traffic_profile_of
from wardlog.plans.dns import CLOCK, DNS_TEXTS, dns_counts, dns_profile_of, running_dns
from wardlog.session import stored

WINDOW = ["src_ip", "window_start", "window_end"]
HOUR = ["src_ip", "lgtime"]


def _verdicts(feedback: DataFrame) -> DataFrame:
    return feedback.withColumnsRenamed({"start_time": "window_start", "end_time": "window_end"}).select(
        "feedback_id", *WINDOW, "feedback"
    )


def _label(profiles: DataFrame, feedback: DataFrame) -> DataFrame:
    columns = [c for c in profiles.columns if c not in (*WINDOW, "lgtime")]
    labelled = profiles.join(_verdicts(feedback), WINDOW)
    return labelled.select("feedback_id", "lgtime", "src_ip", *columns, "feedback")


def _labelled(profiles: Profiles, feedback: DataFrame) -> Profiles:
    """Rows with the verdict, texts by verdict."""
    texts = profiles.texts.join(_verdicts(feedback), WINDOW)
    texts = texts.select("feedback_id", "lgtime", "src_ip", "column", "text", "n")
    return Profiles(("feedback_id", "lgtime", "src_ip"), _label(profiles.rows, feedback), texts, profiles.columns)


def http_feedback(log, feedback, model_id: int) -> Profiles:
    """Hourly traffic profile of each reviewed window, with its verdict.

    An hour that lies in several windows is counted once for all of them.
    """
    verdicts = feedback.where(reviewed(model_id))
    counts = by_window_hour(log, verdicts, traffic_counts)
    return _labelled(traffic_profile_of(counts, [*WINDOW, "lgtime"]), verdicts)


def light_feedback(log, feedback, model_id: int) -> DataFrame:
    """The same without bytes and texts."""
    verdicts = feedback.where(reviewed(model_id))
    return _label(by_window_hour(log, verdicts, lambda rows, keys: traffic_numbers(rows, keys, bytes_too=False)), verdicts)


def dns_feedback(log, feedback, domains, ranges, model_id: int) -> Profiles:
    """DNS profile of each reviewed (address, hour, last event), with its verdict.

    Clock shares are of the whole hour and stay 0 unless the hour's last event
    is the window's end. Of the windows of an hour each one's events are also in
    those that end later: they are counted between ends and added up. Nothing is
    shuffled once texts are in a cell.
    """
    verdicts = feedback.where(reviewed(model_id)).select("feedback_id", "src_ip", "start_time", "end_time", "feedback")
    rows, windows = first_hours(log.select("src_ip", "logtime", "end_time", *DNS_TEXTS), verdicts)
    # texts after all windows are nobody's; the hour's clock has their events
    rows = rows.withColumns({c: F.when(F.col(PLACE) < F.col(PLACES), F.col(c)) for c in DNS_TEXTS})
    # written lists have a known size: small ones are broadcast, and rows stay where they were sorted
    domains, ranges = stored(domains.select("target").distinct(), "domains"), stored(ranges.select("range_start").distinct(), "ranges")
    counts = stored(dns_counts(rows, domains, ranges, [*HOUR, PLACES, PLACE], few=True), "counts")
    hours = dns_profile_of(counts, HOUR).measures.select(*HOUR, "end_time", *CLOCK)
    windows = windows.withColumn("block", block_of(PLACE)).withColumnRenamed("window_end", "end_time")
    verdict = F.struct("feedback_id", "feedback")
    windows = windows.groupBy(*HOUR, "end_time", "block").agg(F.min(PLACE).alias(PLACE), F.sort_array(F.collect_list(verdict)).alias("_verdicts"))
    # the measures up to a place end with its last event
    measures = running_dns(counts, HOUR)
    out = any_match(windows.join(measures, [*HOUR, "end_time"]), hours, [*HOUR, "end_time"], {n: 0.0 for n in CLOCK})
    out = with_texts(out, text_blocks(counts, HOUR, DNS_TEXTS), HOUR, DNS_TEXTS)
    keys = ("feedback_id", "lgtime", "src_ip")
    columns = [c for c in measures.columns if c not in HOUR]
    found = out.withColumns({c: cell(F.col(c)) for c in DNS_TEXTS}).withColumn("_verdict", F.explode("_verdicts"))
    found = found.select("_verdict.feedback_id", "lgtime", "src_ip", *columns, *DNS_TEXTS, *CLOCK, "_verdict.feedback")
    texts = out.select(*HOUR, F.explode("_verdicts").alias("_verdict"), listed(DNS_TEXTS).alias("_texts"))
    texts = texts.select("_verdict.feedback_id", "lgtime", "src_ip", F.inline("_texts"))
    return Profiles(keys, found, texts, DNS_TEXTS)


# Which profile the models of the feedback table are trained on.
HTTP_MODELS, LIGHT_MODELS, DNS_MODELS = (30,), (1,), (40, 41, 42)


def model_feedback(model_id: int, feedback, http_log, dns_log, domains, ranges) -> Profiles | DataFrame | None:
    """Training rows from the verdicts on one model, by the profile it uses; None for other models."""
    if model_id in HTTP_MODELS:
        return http_feedback(http_log, feedback, model_id)
    if model_id in LIGHT_MODELS:
        return light_feedback(http_log, feedback, model_id)
    if model_id in DNS_MODELS:
        return dns_feedback(dns_log, feedback, domains, ranges, model_id)
    return None


def unlike_feedback(samples: DataFrame, verdicts: DataFrame, vector: str, threshold: float = 0.8) -> DataFrame:
    """Samples whose cosine to every feedback vector is below the threshold; a vector without a length stays."""
    columns = sparse(F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")))
    out = unlike(samples.withColumns(columns), verdicts.where(F.col(vector).isNotNull()).withColumns(columns), threshold)
    return out.drop(*columns)


def unlike_profiles(samples: Profiles, verdicts: Profiles, texts: Sequence[str], threshold: float = 0.8, caps: Mapping[str, int] | None = None) -> DataFrame:
    """Measures of the samples whose texts are unlike those of every feedback row.

    The texts become TF-IDF slots fitted on the samples, so a key of any size is one
    sparse vector; vocabularies hold ``caps`` terms (250 a column by default).
    """
    slots = fit_slots(samples, [], caps or {c: 250 for c in texts})
    return unlike(slots.transform(samples), slots.transform(verdicts), threshold)
