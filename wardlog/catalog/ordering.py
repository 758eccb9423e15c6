"""Gaps, sorts, caps, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.registry import listed, query
from wardlog.functions.vectors import by_score
from wardlog.ml.tree import parents
from wardlog.operators.ordering import (
    alerts_first,
    cap_per_class,
    first_rows,
    gaps,
    last_by,
    sample_per_class,
    union_all,
    with_split,
)


@query(
    "w01_event_gaps",
    """SELECT event_id, client_ip, CAST(epoch(logtime) - lag(epoch(logtime)) OVER (
              PARTITION BY client_ip ORDER BY logtime, event_id) AS BIGINT) AS gap FROM login_log""",
)
def w01(d):
    return gaps(d.login_log, "client_ip", "logtime", "event_id").select(
        "event_id", "client_ip", "gap"
    )


@query(
    "w02_parent_lookup",
    """SELECT o.o_orderkey AS node_num, (o.o_orderkey - 1) // 2 AS node_from
       FROM orders o JOIN orders p ON p.o_orderkey = (o.o_orderkey - 1) // 2
       WHERE o.o_orderkey > 0""",
)
def w02(d):
    n = F.col("o_orderkey")
    nodes = d.orders.select(
        n.alias("node_num"), (2 * n + 1).alias("left"), (2 * n + 2).alias("right")
    )
    found = parents(nodes)
    return found.join(nodes.select("node_num"), "node_num", "left_semi")


@query(
    "w03_last_of_sequence",
    """SELECT user_id, event_id, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
       WHERE r = 1""",
)
def w03(d):
    return last_by(d.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query(
    "l01_first_rows",
    "SELECT event_id, src_ip, logtime FROM http_log ORDER BY logtime, src_ip, event_id LIMIT 500",
)
def l01(d):
    rows = d.http_log.select("event_id", "src_ip", "logtime")
    return first_rows(rows, ["logtime", "src_ip", "event_id"], 500)


@query(
    "l02_cap_per_class",
    """SELECT hash, event_id, logtime FROM (
         SELECT *, row_number() OVER (PARTITION BY hash ORDER BY logtime, event_id) AS r
         FROM http_log) WHERE r <= 300""",
)
def l02(d):
    rows = d.http_log.select("hash", "event_id", "logtime")
    return cap_per_class(rows, "hash", ["logtime", "event_id"], 300)


@query(
    "l03_sorted_rows",
    """SELECT logtime, src_ip, dst_ip, end_time FROM http_log
       ORDER BY logtime, src_ip, dst_ip, end_time""",
)
def l03(d):
    keys = ["logtime", "src_ip", "dst_ip", "end_time"]
    return d.http_log.select(*keys).orderBy(*keys)


@query(
    "l04_by_score",
    """SELECT vec_id,
              array_to_string(list_transform(s, lambda x: CAST(x[2] AS BIGINT)), ',') AS place,
              array_to_string(list_transform(s, lambda x: CAST(round(x[1] * 1000000) AS BIGINT)), ',')
              AS score
       FROM (SELECT vec_id, list_reverse_sort(list_transform(embedding,
             lambda v, i: [CAST(v AS DOUBLE), CAST(i AS DOUBLE)])) AS s FROM embeddings)""",
)
def l04(d):
    size = F.size("embedding")
    places = F.sequence(F.lit(1), size).cast("array<double>")
    pairs = by_score(places, F.col("embedding").cast("array<double>"))
    rows = d.embeddings.withColumn("p", pairs)
    return listed(rows, "vec_id", F.col("p.feature"), F.col("p.score"))


@query(
    "l05_alerts_first",
    """SELECT event_id, CASE WHEN hash = 'normal' THEN 'NORMAL' ELSE hash END AS att_name
       FROM http_log""",
)
def l05(d):
    name = F.when(F.col("hash") == "normal", "NORMAL").otherwise(F.col("hash"))
    return alerts_first(d.http_log.select("event_id", name.alias("att_name")))


@query(
    "l06_hash_split",
    """SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT)
              % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM events""",
)
def l06(d):
    return with_split(d.events.select("event_id"), ["event_id"])


@query(
    "l07_class_sample",
    """SELECT event_id, hash FROM http_log
       WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000
             < CASE hash WHEN 'normal' THEN 1000 ELSE 10000 END""",
)
def l07(d):
    shares = {"normal": 0.1, "XSS": 1.0, "BEACONING": 1.0, "SQL_INJECTION": 1.0, "CREDENTIAL": 1.0}
    return sample_per_class(d.http_log.select("event_id", "hash"), "hash", ["event_id"], shares)


@query(
    "u01_union_all",
    """SELECT src_ip, attack_name FROM alert_block
       UNION ALL SELECT src_ip, attack_name FROM alert_waf""",
)
def u01(d):
    return union_all([t.select("src_ip", "attack_name") for t in (d.alert_block, d.alert_waf)])


@query("u02_drop_duplicates", "SELECT DISTINCT src_ip, attack_name FROM alerts")
def u02(d):
    return d.alerts.select("src_ip", "attack_name").dropDuplicates()


@query("u03_distinct_texts", "SELECT DISTINCT lower(text) AS text FROM documents")
def u03(d):
    return d.documents.select(F.lower("text").alias("text")).distinct()
