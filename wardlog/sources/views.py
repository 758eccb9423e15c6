"""Log views derived from the given tables, as SQL both engines read unchanged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# {name} stands for a given table; other names are views of this list.
VIEWS = {
    "ev": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
               event_id % (SELECT count(*) FROM {pages}) AS page_key,
               CASE WHEN user_id % 50 = 7 THEN 'fe80::7'
                    ELSE concat('10.0.', CAST(CAST(floor((user_id % 6) / 2) AS INT) AS STRING),
                                '.', CAST(user_id % 6 AS STRING)) END AS src_ip
        FROM {events}""",
    "pg": """
        SELECT page_id, url,
               regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
               regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path,
               regexp_extract(url, '[?]([^#]*)', 1) AS query,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
        FROM {pages}""",
    "http_log": """
        SELECT e.event_id, date_trunc('hour', e.ts) AS logtime, e.ts AS end_time, e.src_ip,
               concat('192.168.1.', CAST(e.event_id % 2 AS STRING)) AS dst_ip,
               CAST(CASE WHEN e.k % 7 = 0 THEN 50000 + e.k WHEN e.k % 5 = 0 THEN 80
                         WHEN e.k % 5 = 1 THEN 443 WHEN e.k % 5 = 2 THEN 8080
                         ELSE 7 END AS BIGINT) AS dst_port,
               CASE e.event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST'
                    WHEN 'signup' THEN 'PUT' WHEN 'purchase' THEN 'HEAD' ELSE '-' END
                    AS http_method,
               CASE WHEN e.k % 25 = 0 THEN '410' WHEN e.event_type = 'view' THEN '200'
                    WHEN e.event_type = 'click' THEN '302' WHEN e.event_type = 'signup' THEN '101'
                    WHEN e.event_type = 'purchase' THEN '' WHEN e.k % 2 = 0 THEN '500'
                    ELSE '404' END AS http_retcode,
               p.host AS http_host, p.path AS http_path,
               CASE e.k % 20 WHEN 1 THEN 'id=1 union all select 2' WHEN 2 THEN 'q=<script>'
                    WHEN 3 THEN 'f=../../x/../etc/passwd' WHEN 4 THEN 'user_id=a'
                    ELSE p.query END AS http_query,
               CASE WHEN e.k % 20 = 5 THEN concat('Nmap Scripting Engine; ', p.title)
                    ELSE p.title END AS http_agent,
               CASE WHEN e.k % 3 = 0 THEN 'JSESSIONID=1' ELSE '-' END AS http_cookie,
               CASE WHEN e.k % 10 = 0 THEN '-' WHEN e.k % 10 = 1 THEN '1.1.1.1,2.2.2.2'
                    ELSE concat('10.0.0.', CAST(e.k % 6 AS STRING)) END AS http_xfor,
               CAST(floor(e.value * 100) AS BIGINT) AS bytes_forward,
               CAST(floor(e.value * 10) AS BIGINT) AS bytes_backward,
               CAST(e.k AS BIGINT) AS packets_forward,
               CAST(e.k % 13 AS BIGINT) AS packets_backward,
               CASE e.k % 20 WHEN 1 THEN 'SQL_INJECTION' WHEN 2 THEN 'XSS' WHEN 3 THEN 'BEACONING'
                    WHEN 4 THEN 'CREDENTIAL' ELSE 'normal' END AS hash
        FROM ev e JOIN pg p ON p.page_id = e.page_key""",
    "ip_ast": """
        SELECT DISTINCT concat('10.0.0.', CAST(CAST(floor(c_acctbal / 5000) AS INT) AS STRING)) AS ip
        FROM {customer}""",
    "alerts": """
        SELECT src_ip, ts AS logtime, event_type,
               CASE k % 5 WHEN 0 THEN 'SQL Inject attempt' WHEN 1 THEN 'Scan probe' WHEN 2 THEN 'XSS'
                    WHEN 3 THEN 'HTTP Login Brute Force' ELSE 'Vulnerability exploit' END
                    AS attack_name
        FROM ev""",
    "alert_block": "SELECT src_ip, attack_name, logtime FROM alerts WHERE event_type = 'error'",
    "alert_waf": "SELECT src_ip, attack_name, logtime FROM alerts WHERE event_type = 'click'",
    "dns_log": """
        SELECT e.event_id, date_trunc('second', e.ts) AS logtime, e.ts AS end_time, e.src_ip,
               p.host AS dns_query, concat('93.184.', CAST(e.k AS STRING), '.1') AS dns_answer
        FROM ev e JOIN pg p ON p.page_id = e.page_key""",
    "osint": "SELECT DISTINCT host AS target FROM pg WHERE host LIKE '%.net'",
    "range_intel": """
        SELECT DISTINCT concat('10.0.', CAST(CAST(floor(s_acctbal / 5000) AS INT) AS STRING), '.0')
               AS range_start
        FROM {supplier}""",
    "login_log": """
        SELECT event_id, src_ip AS client_ip, date_trunc('second', ts) AS logtime,
               CAST(ts AS DATE) AS logdate,
               CASE k % 6 WHEN 0 THEN 'A1000' WHEN 1 THEN 'H1001' WHEN 2 THEN 'H0015'
                    WHEN 3 THEN 'H0020' WHEN 4 THEN 'H5010' ELSE 'Z9999' END AS service_code,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS result
        FROM ev""",
    "feedback": """
        SELECT event_id AS feedback_id, 30 AS model_id, src_ip,
               date_trunc('day', ts) AS start_time,
               date_trunc('day', ts) + INTERVAL '1' DAY AS end_time,
               k % 6 AS result, CASE WHEN k % 3 = 0 THEN -1 ELSE k % 3 END AS feedback
        FROM ev WHERE event_type = 'error' AND value > 150""",
    "hour_feedback": """
        SELECT event_id AS feedback_id, 40 AS model_id, src_ip,
               date_trunc('hour', ts) AS start_time, ts AS end_time,
               k % 6 AS result, CASE WHEN k % 3 = 0 THEN -1 ELSE k % 3 END AS feedback
        FROM ev WHERE event_type = 'error' AND value > 50""",
    "scores": """
        SELECT event_id, src_ip, ts,
               CASE k % 20 WHEN 1 THEN 'injection' WHEN 2 THEN 'xss' WHEN 3 THEN 'file_download'
                    WHEN 4 THEN 'credential' ELSE 'normal' END AS route,
               CAST(k % 7 AS DOUBLE) / 7 AS attack_score, value / 500 AS recon_error
        FROM ev""",
    "class_scores": """
        SELECT event_id, src_ip, ts,
               CASE WHEN route = 'credential' THEN attack_score ELSE CAST(0 AS DOUBLE) END
                    AS credential,
               CASE WHEN route = 'file_download' THEN attack_score ELSE CAST(0 AS DOUBLE) END
                    AS file_download,
               CASE WHEN route = 'injection' THEN attack_score ELSE CAST(0 AS DOUBLE) END
                    AS injection,
               CASE WHEN route = 'normal' THEN recon_error ELSE CAST(0 AS DOUBLE) END AS normal,
               CASE WHEN route = 'xss' THEN attack_score ELSE CAST(0 AS DOUBLE) END AS xss
        FROM scores""",
    "verdicts": "SELECT vec_id, embedding FROM {embeddings} WHERE label = 0",
    "samples": "SELECT vec_id, embedding FROM {embeddings} WHERE label <> 0",
    "registry": """
        SELECT c_custkey AS model_id, c_name AS model_name,
               concat('{{"train":{{"now_delta":"minutes=', CAST(c_nationkey AS STRING),
                      '","prev_delta":"hours=', CAST(c_custkey % 48 AS STRING),
                      '","crontab":"0 */1 * * *","data_limit":', CAST(c_custkey * 10 AS STRING),
                      ',"vector_size":', CAST(c_nationkey + 1 AS STRING),
                      ',"n_grams_lower":1,"n_grams_upper":2}},',
                      '"predict":{{"now_delta":"seconds=30","prev_delta":"days=',
                      CAST(c_nationkey AS STRING), '","crontab":"*/5 * * * *","data_limit":',
                      CAST(c_custkey AS STRING), ',"vector_size":8',
                      ',"n_grams_lower":1,"n_grams_upper":1}}}}') AS config
        FROM {customer}""",
}
NAMES = re.compile("|".join(rf"\b{n}\b" for n in sorted(VIEWS, key=len, reverse=True)))


def _needed(sql: str, found: dict | None = None) -> dict:
    """Views a text names, each after the views it is built from."""
    found = {} if found is None else found
    for name in NAMES.findall(sql):
        if name not in found and re.search(rf"(FROM|JOIN)\s+{name}\b", sql):
            _needed(VIEWS[name], found)
            found[name] = VIEWS[name]
    return found


def with_views(sql: str, **tables: str) -> str:
    """The query with its views in front; tables keep their names unless replaced."""
    names = {t: tables.get(t, t) for t in TABLES}
    views = ",\n".join(f"{n} AS ({v.format(**names)})" for n, v in _needed(sql).items())
    if not views:
        return sql
    own = re.match(r"\s*WITH\s", sql)
    return f"WITH {views},\n{sql[own.end():]}" if own else f"WITH {views}\n{sql}"


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps as zone-less ones of the session zone."""
    zoned = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


class Data:
    """The tables and views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def sql(self, text: str, **tables: str) -> DataFrame:
        names = {t: f"parquet.`{self.path(t)}`" for t in TABLES}
        names.update(tables)
        return plain_times(self.spark.sql(with_views(text, **names)))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return plain_times(self.spark.read.parquet(self.path(name)))
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
