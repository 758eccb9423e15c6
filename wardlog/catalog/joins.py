"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.filters import ATTEMPT
from wardlog.catalog.registry import clock_sql, query, ratio
from wardlog.functions.times import day_number
from wardlog.functions.vectors import class_c
from wardlog.operators.joins import (
    any_match,
    drop_listed,
    flag_listed,
    in_either,
    keep_listed,
    members_of_stored_days,
    share_of_total,
    with_one_row,
)
from wardlog.operators.predicates import attempt_or_vulnerability, reviewed
from wardlog.operators.windows import by_window
from wardlog.plans.detectors import alerted
from wardlog.plans.dns import clock_ratios
from wardlog.plans.logins import enriched, outcome_counts
from wardlog.session import scratch
from wardlog.sources.sinks import write_by_day

OUTCOME_SQL = ", ".join(
    f"count(*) FILTER (WHERE service_code = '{c}' AND result = {r}) AS {c}_{r}"
    for c in ("H0015", "H0020", "H1001", "H5010", "A1000") for r in (0, 1)
)


@query(
    "j01_not_assets",
    """SELECT event_id, src_ip, dst_ip FROM http_log l
       WHERE NOT EXISTS (SELECT 1 FROM ip_ast a WHERE a.ip = l.src_ip)""",
)
def j01(d):
    return drop_listed(d.http_log, d.ip_ast, "src_ip", "ip").select("event_id", "src_ip", "dst_ip")


@query(
    "j02_alerted_traffic",
    f"""SELECT event_id, src_ip, dst_ip FROM http_log WHERE src_ip IN (
          SELECT src_ip FROM alert_block WHERE {ATTEMPT} GROUP BY src_ip HAVING count(*) >= 100)""",
)
def j02(d):
    loud = (
        d.alert_block.where(attempt_or_vulnerability())
        .groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")).where("n >= 100")
    )
    return keep_listed(d.http_log, loud, "src_ip").select("event_id", "src_ip", "dst_ip")


@query(
    "j03_either_alert_source",
    """SELECT coalesce(b.src_ip, w.src_ip) AS src_ip FROM
         (SELECT src_ip FROM alert_block WHERE attack_name LIKE '%SQL%'
          GROUP BY 1 HAVING count(*) >= 58) b
       FULL OUTER JOIN
         (SELECT src_ip FROM alert_waf WHERE attack_name LIKE '%Inject%'
          GROUP BY 1 HAVING count(*) >= 62) w ON b.src_ip = w.src_ip""",
)
def j03(d):
    def loud(alerts, pattern, least):
        rows = alerts.where(F.col("attack_name").like(pattern))
        counted = rows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
        return counted.where(F.col("n") >= least)

    return in_either(loud(d.alert_block, "%SQL%", 58), loud(d.alert_waf, "%Inject%", 62), "src_ip")


@query(
    "j03_alerted_addresses",
    f"""SELECT DISTINCT src_ip FROM (
          SELECT src_ip FROM alert_block WHERE {ATTEMPT} GROUP BY 1 HAVING count(*) >= 120
          UNION ALL
          SELECT src_ip FROM alert_waf WHERE {ATTEMPT} GROUP BY 1 HAVING count(*) >= 120)""",
)
def j03_alerted(d):
    return alerted(d.alert_block, d.alert_waf, {1: 120}).select("src_ip")


@query(
    "j04_any_match",
    """SELECT l.event_id, l.dns_query, coalesce(f.first_id, -1) AS first_id
       FROM dns_log l LEFT JOIN
         (SELECT src_ip, min(feedback_id) AS first_id FROM feedback WHERE feedback = 2 GROUP BY 1) f
         ON f.src_ip = l.src_ip""",
)
def j04(d):
    right = d.feedback.where(F.col("feedback") == 2)
    right = right.select("src_ip", F.col("feedback_id").alias("first_id"))
    out = any_match(d.dns_log, right, "src_ip", {"first_id": -1})
    return out.select("event_id", "dns_query", "first_id")


@query(
    "j05_one_row_sets",
    f"""SELECT a.*, b.hits FROM
          (SELECT 1 AS idx, count(*) AS cnt, {clock_sql()} FROM dns_log) a
        LEFT JOIN (SELECT 1 AS idx, avg(CASE WHEN dns_query IN (SELECT target FROM osint)
                                        THEN 1 ELSE 0 END) AS hits FROM dns_log) b
        ON a.idx = b.idx""",
)
def j05(d):
    log = d.dns_log
    clock = log.agg(
        F.count(F.lit(1)).alias("cnt"), *[c.alias(n) for n, c in clock_ratios().items()]
    )
    hits = flag_listed(log, d.osint, "dns_query", "target", "hit").agg(F.avg("hit").alias("hits"))
    return with_one_row(clock, hits).withColumn("idx", F.lit(1))


ENRICHED = f"""
    SELECT p.src_ip, p.lgtime, p.cnt, CAST(a.ip IS NOT NULL AS INT) AS asset, o.* EXCLUDE (client_ip)
    FROM (SELECT src_ip, logtime AS lgtime, count(*) AS cnt FROM http_log GROUP BY 1, 2) p
    LEFT JOIN ip_ast a ON a.ip = p.src_ip
    LEFT JOIN (SELECT client_ip, {OUTCOME_SQL} FROM login_log
               WHERE logtime BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15'
               GROUP BY 1) o ON o.client_ip = p.src_ip
"""


@query(
    "j06_enriched_profiles",
    f"SELECT * REPLACE (" + ", ".join(
        f"coalesce({c}_{r}, 0) AS {c}_{r}"
        for c in ("H0015", "H0020", "H1001", "H5010", "A1000") for r in (0, 1)
    ) + f") FROM ({ENRICHED})",
)
def j06(d):
    profiles = d.http_log.groupBy("src_ip", F.col("logtime").alias("lgtime")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return enriched(profiles, d.ip_ast, outcome_counts(d.login_log, "2024-01-15"))


@query(
    "j06_asset_flag_cleared",
    """SELECT u.src_ip, CASE WHEN o.a > 0 AND o.others = 0 THEN 0
              ELSE CAST(u.src_ip IN (SELECT ip FROM ip_ast) AS INT) END AS asset
       FROM (SELECT DISTINCT client_ip AS src_ip FROM login_log) u LEFT JOIN (
         SELECT client_ip,
                count(*) FILTER (WHERE service_code = 'A1000' AND result = 1) AS a,
                count(*) FILTER (WHERE service_code IN ('H0015', 'H0020', 'H1001', 'H5010')
                                 AND result = 1) AS others
         FROM login_log WHERE logtime BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15'
         GROUP BY 1) o ON o.client_ip = u.src_ip""",
)
def j06_cleared(d):
    clients = d.login_log.select(F.col("client_ip").alias("src_ip")).distinct()
    outcomes = outcome_counts(d.login_log, "2024-01-15")
    out = enriched(clients, d.ip_ast, outcomes, clear_asset_flag=True)
    return out.select("src_ip", "asset")


@query(
    "j07_row_aligned",
    """SELECT s.event_id, s.route, h.http_method, h.dst_port
       FROM scores s JOIN http_log h ON h.event_id = s.event_id""",
)
def j07(d):
    scores = d.scores.select("event_id", "route")
    return scores.join(d.http_log.select("event_id", "http_method", "dst_port"), "event_id")


@query(
    "j08_window_members",
    f"""SELECT f.feedback_id, f.feedback, count(*) AS cnt, max(l.end_time) AS end_time,
               {ratio("l.http_method = 'GET'")} AS get_share
        FROM feedback f JOIN http_log l ON l.src_ip = f.src_ip AND l.logtime >= f.start_time
             AND l.end_time <= f.end_time
        WHERE f.feedback <> -1 GROUP BY 1, 2""",
)
def j08(d):
    verdicts = d.feedback.where(reviewed(30))
    named = verdicts.withColumnsRenamed({"start_time": "window_start", "end_time": "window_end"})
    sums = by_window(d.http_log, verdicts, _requests, _added_requests)
    share = (F.col("gets") / F.col("cnt")).alias("get_share")
    return named.join(sums, ["src_ip", "window_start", "window_end"]).select(
        "feedback_id", "feedback", "cnt", F.col("last").alias("end_time"), share
    )


def _requests(rows, keys):
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("end_time").alias("last"),
        F.count_if(F.col("http_method") == "GET").alias("gets"),
    )


def _added_requests(parts, keys):
    return parts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.max("last").alias("last"), F.sum("gets").alias("gets"))


@query(
    "j08_long_windows",
    f"""SELECT w.src_ip, w.start_time, w.end_time, count(*) AS cnt, max(l.end_time) AS last,
               count(*) FILTER (WHERE http_method = 'GET') AS gets
        FROM (SELECT DISTINCT src_ip, start_time - INTERVAL 100 HOUR AS start_time, end_time + to_minutes(CAST(result AS INT) * 700) AS end_time
              FROM feedback) w
        JOIN http_log l ON l.src_ip = w.src_ip AND l.logtime >= w.start_time AND l.end_time <= w.end_time GROUP BY 1, 2, 3""",
)
def j08_long(d):
    """Windows of many days that overlap each other."""
    start = F.col("start_time") - F.expr("interval 100 hours")
    end = F.col("end_time") + F.expr("make_dt_interval(0, 0, cast(result as int) * 700)")
    windows = d.feedback.withColumns({"start_time": start, "end_time": end})
    out = by_window(d.http_log, windows, _requests, _added_requests)
    return out.withColumnsRenamed({"window_start": "start_time", "window_end": "end_time"})


@query(
    "j08_stored_days",
    """SELECT f.feedback_id, count(*) AS cnt, max(l.end_time) AS end_time
       FROM feedback f JOIN http_log l ON l.src_ip = f.src_ip AND l.logtime >= f.start_time AND l.end_time <= f.end_time
       WHERE f.feedback <> -1 AND f.result = 5 AND f.start_time = (SELECT max(start_time) FROM feedback WHERE feedback <> -1 AND result = 5)
       GROUP BY 1""",
)
def j08_days(d):
    """Members of the latest window in a log stored by day: only its days are read."""
    path = scratch(d.spark, "days")
    rows = d.http_log.select("event_id", "src_ip", "logtime", "end_time", day_number(F.col("logtime")).alias("logdate"))
    write_by_day(rows, path)
    reviewed_ = d.feedback.where("feedback <> -1 AND result = 5")
    last = reviewed_.where(F.col("start_time") == reviewed_.agg(F.max("start_time")).scalar())
    members = members_of_stored_days(d.spark.read.parquet(path), last)
    counts = members.groupBy("src_ip", "window_start", "window_end").agg(F.count(F.lit(1)).alias("cnt"), F.max("end_time").alias("last"))
    named = last.withColumnsRenamed({"start_time": "window_start", "end_time": "window_end"})
    return named.join(counts, ["src_ip", "window_start", "window_end"]).select("feedback_id", "cnt", F.col("last").alias("end_time"))


@query(
    "j09_share_of_all",
    """SELECT dns_query, count(*) AS n,
              count(*) / CAST((SELECT count(*) FROM dns_log) AS DOUBLE) AS share
       FROM dns_log GROUP BY 1""",
)
def j09(d):
    return share_of_total(d.dns_log.groupBy("dns_query").agg(F.count(F.lit(1)).alias("n")), "n")


@query(
    "j10_range_intel",
    """SELECT event_id, src_ip,
              CAST(regexp_replace(src_ip, '[.][0-9]+$', '.xxx') IN (
                SELECT regexp_replace(range_start, '[.][0-9]+$', '.xxx') FROM range_intel) AS INT)
              AS listed
       FROM dns_log""",
)
def j10(d):
    ranges = d.range_intel.select(class_c(F.col("range_start")).alias("ip_range"))
    rows = d.dns_log.withColumn("ip_range", class_c(F.col("src_ip")))
    out = flag_listed(rows, ranges, "ip_range", "ip_range", "listed")
    return out.select("event_id", "src_ip", "listed")


@query(
    "j11_domain_intel",
    """SELECT event_id, dns_query, CAST(dns_query IN (SELECT target FROM osint) AS INT) AS listed
       FROM dns_log""",
)
def j11(d):
    out = flag_listed(d.dns_log, d.osint, "dns_query", "target", "listed")
    return out.select("event_id", "dns_query", "listed")
