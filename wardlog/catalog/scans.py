"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.registry import query
from wardlog.catalog.scoring import RESULT_ROWS_SQL, m24
from wardlog.functions.times import day_number
from wardlog.ml.scoring import as_text_copy
from wardlog.operators.ordering import cap_per_class
from wardlog.operators.predicates import has_text
from wardlog.session import scratch
from wardlog.sources import sinks
from wardlog.sources.runs import RunTables
from wardlog.sources.tables import (
    from_sources,
    labelled,
    latest_version,
    read_window,
    run_config,
    stored_columns,
)

LABELS = {
    "BEACONING": "file_download",
    "SQL_INJECTION": "injection",
    "CREDENTIAL": "credential",
    "XSS": "xss",
}
RESULT_SQL = """
    SELECT CAST(334 AS BIGINT) AS model_id, ts AS start_time, ts AS end_time, src_ip,
           '192.168.1.1' AS dst_ip, CAST(k AS BIGINT) AS dst_port,
           CAST(k % 6 AS DOUBLE) AS result, value / 1000 AS probs
    FROM ev
"""


def results(d):
    return d.sql(RESULT_SQL.strip())


@query(
    "s01_window_scan",
    """SELECT event_id, ts, user_id, event_type FROM events
       WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""",
)
def s01(d):
    rows = read_window(
        d.spark, d.path("events"), "ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00"
    )
    return rows.select("event_id", "ts", "user_id", "event_type")


@query(
    "s02_tagged_sources",
    """SELECT source_name, key, name FROM (
         SELECT 'main' AS source_name, c_custkey AS key, c_name AS name FROM customer
         UNION ALL SELECT 'copy', c_custkey, c_name FROM customer)""",
)
def s02(d):
    both = from_sources(d.spark, {"main": d.path("customer"), "copy": d.path("customer")})
    return both.select("source_name", F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))


@query(
    "s03_stored_columns",
    """SELECT u.name AS column_name, count(u.v) AS non_null FROM (
         SELECT unnest(['event_id', 'user_id', 'event_type', 'value', 'props']) AS name,
                unnest([CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type,
                        CAST(value AS VARCHAR), props]) AS v FROM events) u GROUP BY 1""",
)
def s03(d):
    events = d.events
    names = stored_columns(events, derived=["ts"])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("n"), F.col(c).cast("string").alias("v")) for c in names]
    )
    rows = events.select(F.explode(pairs).alias("p"))
    return rows.groupBy(F.col("p.n").alias("column_name")).agg(F.count("p.v").alias("non_null"))


@query(
    "s04_labelled_scan",
    """SELECT event_id, logtime, src_ip, dst_ip, label FROM (
         SELECT *, CASE hash WHEN 'BEACONING' THEN 'file_download'
                   WHEN 'SQL_INJECTION' THEN 'injection' WHEN 'CREDENTIAL' THEN 'credential'
                   WHEN 'XSS' THEN 'xss' END AS label FROM http_log)
       WHERE label IS NOT NULL AND NOT (http_host = '' AND http_agent = '' AND http_query = '')""",
)
def s04(d):
    rows = labelled(d.http_log.where(has_text()), "hash", LABELS)
    rows = cap_per_class(rows, "label", ["logtime", "src_ip", "dst_ip", "event_id"], None)
    return rows.select("event_id", "logtime", "src_ip", "dst_ip", "label")


@query(
    "s05_append_results",
    f"""SELECT model_id, src_ip, dst_ip, dst_port, result, probs, '-' AS feedback,
          CAST(0 AS BIGINT) AS packet, CAST(strftime(start_time, '%Y%m%d') AS INT) AS logdate
        FROM ({RESULT_SQL})""",
)
def s05(d):
    root = scratch(d.spark, "append")
    sinks.append_rows(results(d), root, "result")
    back = sinks.read_rows(d.spark, root, "result")
    return back.select(
        "model_id", "src_ip", "dst_ip", "dst_port", "result", "probs", "feedback",
        F.col("packet").cast("bigint").alias("packet"), "logdate",
    )


@query(
    "s06_created_tables",
    """SELECT 'history' AS name, count(*) AS n FROM events WHERE false
       UNION ALL SELECT 'result', count(*) FROM events
       UNION ALL SELECT 'cluster', count(*) FROM events WHERE false
       UNION ALL SELECT 'feedback', count(*) FROM events WHERE false""",
)
def s06(d):
    root = scratch(d.spark, "create")
    sinks.create_tables(d.spark, root)
    sinks.append_rows(results(d), root, "result")
    sinks.create_tables(d.spark, root)
    out = None
    for table in sinks.SCHEMAS:
        rows = sinks.read_rows(d.spark, root, table)
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "s07_derived_columns",
    f"""SELECT model_id, start_time AS logtime,
          CAST(strftime(start_time, '%Y%m%d') AS INT) AS logdate, src_ip, dst_ip,
          md5(concat_ws('|', CAST(model_id AS VARCHAR), strftime(start_time, '%Y-%m-%d %H:%M:%S'),
              src_ip, dst_ip, CAST(result AS VARCHAR))) AS hash
        FROM ({RESULT_SQL})""",
)
def s07(d):
    rows = sinks.with_derived(results(d), "result")
    return rows.select("model_id", "logtime", "logdate", "src_ip", "dst_ip", "hash")


@query(
    "s08_day_partitions",
    """SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS logdate, count(*) AS n,
              min(ts) AS first_time, max(ts) AS last_time FROM ev GROUP BY 1""",
)
def s08(d):
    path = scratch(d.spark, "days")
    rows = sinks.with_derived(results(d), "result")
    sinks.write_by_day(rows, path)
    return (
        d.spark.read.parquet(path)
        .groupBy("logdate")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("logtime").alias("first_time"),
            F.max("logtime").alias("last_time"),
        )
    )


@query(
    "s09_bounded_files",
    """SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS logdate, count(*) AS n,
              true AS bounded FROM ev GROUP BY 1""",
)
def s09(d):
    path = scratch(d.spark, "bounded")
    rows = sinks.with_derived(results(d), "result")
    sinks.write_by_day(rows, path, max_records=1000)
    files = (
        d.spark.read.parquet(path)
        .groupBy("logdate", F.input_file_name().alias("file"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return files.groupBy("logdate").agg(
        F.sum("n").alias("n"), (F.max("n") <= 1000).alias("bounded")
    )


@query(
    "s10_snapshot",
    "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
)
def s10(d):
    root = scratch(d.spark, "snapshot")
    sinks.write_snapshot(d.events, root, "2024_01_31_00_00")
    rows = sinks.read_snapshot(d.spark, root, "2024_01_31_00_00")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "s12_latest_version",
    """SELECT max(v) AS model_ver FROM (
         SELECT strftime(ts, '%Y_%m_%d_%H_%M') AS v FROM events WHERE event_type = 'signup')
       WHERE v <= '2024_01_15_12_00'""",
)
def s12(d):
    made = d.events.where(F.col("event_type") == "signup")
    versions = made.select(F.date_format("ts", "yyyy_MM_dd_HH_mm").alias("model_ver"))
    return latest_version(versions, "2024_01_15_12_00")


@query(
    "s13_run_config",
    """SELECT model_id, model_name,
              json_extract_string(config, '$.train.now_delta') AS now_delta,
              json_extract_string(config, '$.train.prev_delta') AS prev_delta,
              json_extract_string(config, '$.train.crontab') AS crontab,
              CAST(json_extract_string(config, '$.train.data_limit') AS BIGINT) AS data_limit,
              CAST(json_extract_string(config, '$.train.vector_size') AS INT) AS vector_size
       FROM registry""",
)
def s13(d):
    return run_config(d.registry, "train").drop("n_grams_lower", "n_grams_upper")


METRICS_SQL = """
    SELECT 334 AS model_id, CASE event_type WHEN 'view' THEN 'XSS' WHEN 'click' THEN 'CREDENTIAL'
           WHEN 'signup' THEN 'SQL_INJECTION' ELSE 'NORMAL' END AS attack_name,
           event_id AS epochs, value AS loss, value / 1000 AS accuracy
    FROM ev
"""
SCORES_SQL = """
    SELECT CASE event_type WHEN 'view' THEN 'XSS' ELSE 'CREDENTIAL' END AS attack_name,
           count(*) AS train_cnt, count(*) AS test_cnt, CAST(max(k) AS DOUBLE) AS accuracy,
           CAST(min(k) AS DOUBLE) AS recall, CAST(max(k) AS DOUBLE) AS precision,
           CAST(max(k) AS DOUBLE) AS f1_score
    FROM ev WHERE event_type IN ('view', 'click') GROUP BY event_type
"""


@query(
    "s14_training_history",
    f"""WITH m AS (SELECT attack_name, max(epochs) AS epochs FROM ({METRICS_SQL}) GROUP BY 1),
        s AS ({SCORES_SQL})
        SELECT m.attack_name, m.epochs, x.loss, coalesce(s.train_cnt, 0) AS train_cnt,
               coalesce(s.test_cnt, 0) AS test_cnt, coalesce(s.accuracy, 0) AS accuracy,
               coalesce(s.recall, 0) AS recall, coalesce(s.precision, 0) AS precision,
               coalesce(s.f1_score, 0) AS f1_score
        FROM m JOIN ({METRICS_SQL}) x ON x.epochs = m.epochs
        LEFT JOIN s ON s.attack_name = m.attack_name""",
)
def s14(d):
    out = sinks.training_history(d.sql(METRICS_SQL.strip()), d.sql(SCORES_SQL.strip()))
    return out.drop("model_id")


@query(
    "s08_day_pruned_read",
    """SELECT count(*) AS n, round(sum(value), 2) AS total FROM ev
       WHERE CAST(ts AS DATE) = DATE '2024-01-15'""",
)
def s08_read(d):
    path = scratch(d.spark, "pruned")
    rows = d.events.select("ts", "value", day_number(F.col("ts")).alias("logdate"))
    sinks.write_by_day(rows, path, order="ts")
    day = d.spark.read.parquet(path).where(F.col("logdate") == 20240115)
    return day.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


RUN_RESULT_SQL = RESULT_ROWS_SQL


@query("s05_result_table", f"SELECT *, CAST(strftime(logtime, '%Y%m%d') AS INT) AS logdate FROM ({RUN_RESULT_SQL})")
def s05_results(d):
    """The 25 result columns, stored by two runs of which one is repeated, and read back."""
    tables = RunTables(d.spark, scratch(d.spark, "results"))
    rows = m24(d)
    early = F.col("logtime") < F.lit("2024-01-15").cast("timestamp_ntz")
    tables.commit("early", {"result": rows.where(early)})
    tables.commit("late", {"result": rows.where(~early)})
    tables.commit("early", {"result": rows})
    return tables.read("result")


@query(
    "s05_result_text_copy",
    f"""SELECT * EXCLUDE (probs), probs IS NOT NULL AS has_probs, round(CAST(probs AS DOUBLE), 9) AS number
        FROM ({RUN_RESULT_SQL})""",
)
def s05_text(d):
    """The text copy; its probabilities read as numbers again."""
    tables = RunTables(d.spark, scratch(d.spark, "results"))
    rows = m24(d)
    tables.commit("run-1", {"result": rows, "result_text": as_text_copy(rows)})
    back = tables.read("result_text").drop("logdate")
    number = F.round(F.col("probs").cast("double"), 9).alias("number")
    return back.select("*", F.col("probs").isNotNull().alias("has_probs"), number).drop("probs")


@query(
    "s14_history_table",
    f"""WITH m AS (SELECT attack_name, max(epochs) AS epochs FROM ({METRICS_SQL}) GROUP BY 1), s AS ({SCORES_SQL})
        SELECT CAST(334 AS BIGINT) AS model_id, m.attack_name, m.epochs, x.loss, TIMESTAMP '2024-02-01 00:00:00' AS logtime,
               coalesce(s.train_cnt, 0) AS train_cnt, coalesce(s.test_cnt, 0) AS test_cnt, coalesce(s.accuracy, 0) AS accuracy,
               coalesce(s.recall, 0) AS recall, coalesce(s.precision, 0) AS precision, coalesce(s.f1_score, 0) AS f1_score,
               20240201 AS logdate, (SELECT count(*) FROM ev) AS metrics
        FROM m JOIN ({METRICS_SQL}) x ON x.epochs = m.epochs LEFT JOIN s ON s.attack_name = m.attack_name""",
)
def s14_table(d):
    """Metrics and history of a training run, stored together and read back."""
    tables = RunTables(d.spark, scratch(d.spark, "history"))
    metrics = d.sql(METRICS_SQL.strip()).withColumn("logtime", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    history = sinks.training_history(metrics, d.sql(SCORES_SQL.strip()))
    for _ in range(2):
        tables.commit("train-334", {"metrics": metrics, "history": history})
    n = tables.read("metrics").agg(F.count(F.lit(1))).scalar()
    return tables.read("history").withColumn("metrics", n)
