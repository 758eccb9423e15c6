"""Scheduled and streaming runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlog.catalog.models import KEYS, MODEL_ID, NAMES, VERSION, agreement, bundle, labelled_results
from wardlog.catalog.registry import HAS_TEXT, method_sql, query, status_sql
from wardlog.functions.times import run_window
from wardlog.ml.scoring import result_rows
from wardlog.operators.predicates import in_range
from wardlog.operators.profiles import status_ratios
from wardlog.plans.extraction import http_counts, http_profile_of, merged_http_counts
from wardlog.plans.jobs import predict, train
from wardlog.session import scratch
from wardlog.sources.runs import RunTables
from wardlog.streaming import jobs


def events_stream(d):
    """The events as a stream of three files, a batch each."""
    path = scratch(d.spark, "arriving")
    d.spark.read.parquet(d.path("events")).repartition(3, "event_id").write.parquet(path)
    return jobs.read_files(d.spark, path, 1)


def http_stream(d):
    """The HTTP log view over the streamed events."""
    name = f"events_{uuid.uuid4().hex}"
    events_stream(d).createOrReplaceTempView(name)
    return d.sql("SELECT * FROM http_log", events=name)


@query(
    "t01_lookback_window",
    f"""SELECT src_ip, count(*) AS cnt, {status_sql()} FROM http_log
        WHERE end_time BETWEEN (SELECT max(ts) + INTERVAL 9 HOUR - INTERVAL 10 HOUR - INTERVAL 7 DAY FROM events)
          AND (SELECT max(ts) + INTERVAL 9 HOUR - INTERVAL 10 HOUR FROM events) GROUP BY 1""",
)
def t01(d):
    now = d.events.agg(F.max("ts").alias("now")).withColumns(
        {"back": F.lit("hours=10"), "span": F.lit("days=7")}
    )
    window = run_window(now, "now", "back", "span")
    start, end = window.select(*[F.col(c).cast("string") for c in ("logtime_s", "logtime_e")]).first()
    rows = d.http_log.where(in_range("end_time", start, end))
    return rows.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("cnt"), *[c.alias(n) for n, c in status_ratios().items()]
    )


@query(
    "t02_streamed_profile",
    f"""SELECT date_trunc('hour', end_time) AS lgtime, src_ip, dst_ip, max(end_time) AS end_time,
        count(*) AS cnt, count(DISTINCT dst_port) AS ports,
        CAST(sum(bytes_forward) AS BIGINT) AS bytes, {method_sql()}, {status_sql()}
        FROM http_log GROUP BY 1, 2, 3""",
)
def t02(d):
    return jobs.run_hourly_profile(http_stream(d), scratch(d.spark, "hourly"))


@query("t03_streamed_scores")
def t03(d):
    models = bundle(d)

    def score(counts):
        rows = http_profile_of(counts).renamed(NAMES)
        return result_rows(labelled_results(d, models.score(rows)), MODEL_ID, VERSION)

    return jobs.run_scoring(http_stream(d), scratch(d.spark, "scores"), KEYS, http_counts, merged_http_counts, score)


@query("t03_streamed_equals_batch", "SELECT count(*) AS keys, CAST(0 AS BIGINT) AS mismatches FROM (SELECT DISTINCT logtime, src_ip, dst_ip FROM http_log)")
def t03_batch(d):
    """Streamed scores against those of the whole log, key by key."""
    models = bundle(d)

    def score(counts):
        rows = http_profile_of(counts).renamed(NAMES)
        return result_rows(labelled_results(d, models.score(rows)), MODEL_ID, VERSION)

    streamed = jobs.run_scoring(http_stream(d), scratch(d.spark, "scores"), KEYS, http_counts, merged_http_counts, score)
    return agreement(streamed, score(http_counts(d.http_log)).select(*streamed.columns), KEYS)


@query(
    "t04_streamed_dictionary",
    """SELECT event_type, 'value' AS "column", CAST(value AS VARCHAR) AS token, count(*) AS cnt
       FROM events GROUP BY 1, 3""",
)
def t04(d):
    stream = events_stream(d)
    out = jobs.run_token_counts(
        stream, scratch(d.spark, "dictionary"), numbers=["value"], groups=["event_type"]
    )
    return out.select("event_type", "column", "token", "cnt")


# The registered model with the longest training window of the highest number.
JOB_MODEL = "(SELECT max(c_custkey) FROM customer WHERE c_custkey % 48 >= 40 AND c_nationkey >= 5)"


@query(
    "t01_train_and_predict",
    f"""WITH m AS (SELECT c_custkey AS id, c_nationkey AS days FROM customer WHERE c_custkey = {JOB_MODEL}),
        w AS (SELECT max(ts) AS now, max(ts) + INTERVAL 9 HOUR - INTERVAL 30 SECOND AS e FROM events)
        SELECT CAST((SELECT id FROM m) AS BIGINT) AS model_id, logtime, src_ip, dst_ip, max(end_time) AS "end",
               strftime((SELECT now FROM w), '%Y_%m_%d_%H_%M') AS feedback, '-' AS rule
        FROM http_log
        WHERE logtime BETWEEN (SELECT e FROM w) - to_days(CAST((SELECT days FROM m) AS INT)) AND (SELECT e FROM w)
          AND {HAS_TEXT}
        GROUP BY logtime, src_ip, dst_ip ORDER BY logtime, src_ip, dst_ip LIMIT (SELECT id FROM m)""",
)
def t01_jobs(d):
    """Rows stored by a prediction job, run twice, after a training job of the same registry row."""
    wanted = d.customer.where("c_custkey % 48 >= 40 AND c_nationkey >= 5").agg(F.max("c_custkey"))
    model_id, now = wanted.first()[0], d.events.agg(F.max("ts")).first()[0]
    root = scratch(d.spark, "jobs")
    train(d.spark, d.registry, model_id, now, d.http_log, d.ip_ast, root)
    for _ in range(2):
        predict(d.spark, d.registry, model_id, now, d.http_log, root)
    rows = RunTables(d.spark, f"{root}/tables").read("result")
    return rows.select("model_id", "logtime", "src_ip", "dst_ip", "end", "feedback", "rule")
