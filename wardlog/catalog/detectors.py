"""Extractions and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.aggregates import (
    ATTACK_SQL,
    INTEL,
    KEYWORD_LOG,
    PROFILE_SQL,
    URL_COLUMNS,
    WIDE_TIMES,
    WORD_COLUMNS,
    round_moments,
    attack_out,
)
from wardlog.catalog.filters import (
    ATTEMPT,
    CREDENTIAL,
    FILE_PROBE,
    INJECTION,
    SCANNER,
    SPOOFED,
    XSS,
)
from wardlog.catalog.registry import (
    HAS_TEXT,
    NOT_ASSET,
    clean_sql,
    clock_sql,
    method_sql,
    query,
    status_sql,
    texts_sql,
    traffic_sql,
    url_chars_sql,
    whole_sql,
)
from wardlog.plans.detectors import (
    ALERT_OFFSETS,
    alert_detector,
    asset_lookup,
    hijack_detector,
    signature_detector,
)
from wardlog.plans.dns import CLOCK
from wardlog.plans.extraction import attack_rows, normal_rows, prediction_rows, training_rows
from wardlog.plans.feedback import dns_feedback, http_feedback, light_feedback, model_feedback

DAY = "2024-01-08"
LABEL_CASE = """CASE hash WHEN 'BEACONING' THEN 'file_download' WHEN 'SQL_INJECTION' THEN 'injection'
    WHEN 'CREDENTIAL' THEN 'credential' WHEN 'XSS' THEN 'xss' END"""
ATTACK_ROWS = f"""
    SELECT {LABEL_CASE} AS label, logtime, src_ip, dst_ip, {PROFILE_SQL}
    FROM http_log WHERE hash <> 'normal' AND {HAS_TEXT} AND src_ip LIKE '%.%.%.%' AND {NOT_ASSET}
    GROUP BY 1, 2, 3, 4"""
NORMAL_ROWS = f"""
    SELECT 'normal' AS label, logtime, src_ip, dst_ip, {PROFILE_SQL}
    FROM http_log WHERE logtime BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25'
      AND {HAS_TEXT} GROUP BY 2, 3, 4"""


@query("d01_attack_training_rows", ATTACK_ROWS)
def d01(d):
    return attack_rows(d.http_log, d.ip_ast).rows


@query("d02_normal_training_rows", NORMAL_ROWS)
def d02(d):
    return normal_rows(d.http_log, "2024-01-02 00:00:00", "2024-01-25 00:00:00").rows


@query(
    "d03_prediction_rows",
    f"""SELECT logtime, src_ip, dst_ip, {PROFILE_SQL} FROM http_log
        WHERE logtime BETWEEN TIMESTAMP '{WIDE_TIMES[0]}' AND TIMESTAMP '{WIDE_TIMES[1]}'
          AND {HAS_TEXT} GROUP BY 1, 2, 3""",
)
def d03(d):
    return prediction_rows(d.http_log, *WIDE_TIMES).rows


@query(
    "d03_prediction_texts",
    texts_sql(
        f"""(SELECT * FROM http_log WHERE logtime BETWEEN TIMESTAMP '{WIDE_TIMES[0]}'
            AND TIMESTAMP '{WIDE_TIMES[1]}' AND {HAS_TEXT})""",
        "logtime, src_ip, dst_ip", {"agent_": clean_sql("http_agent"), "query_": clean_sql("http_query")},
    ),
)
def d03_texts(d):
    return prediction_rows(d.http_log, *WIDE_TIMES).texts


@query("d01_d02_training_set", f"{NORMAL_ROWS} UNION ALL {ATTACK_ROWS}")
def training_set(d):
    out = training_rows(d.http_log, d.ip_ast, "2024-01-02 00:00:00", "2024-01-25 00:00:00").rows
    first = ("label", "logtime", "src_ip", "dst_ip")
    return out.select(*first, *[c for c in out.columns if c not in first])


# Detector code -> (name, days before and after, condition).
SIGNATURES = {
    1: ("d04_beaconing", (0, 31), FILE_PROBE),
    2: ("d05_injection", (-31, 31), INJECTION),
    3: ("d06_spoofing", (0, 3), SPOOFED),
    4: ("d07_scanning", (-31, 31), SCANNER),
    5: ("d08_credential", (0, 2), CREDENTIAL),
    6: ("d09_xss", (0, 31), XSS),
}


def signature_sql(code: int, least: int) -> str:
    _, (first, last), condition = SIGNATURES[code]
    having = f"HAVING count(*) >= {least + 10}" if code == 3 else ""
    return f"""SELECT {code} AS code, date_trunc('hour', logtime) AS hour, src_ip, dst_ip,
        {ATTACK_SQL} FROM {KEYWORD_LOG}
        WHERE logtime BETWEEN TIMESTAMP '{DAY}' + INTERVAL ({first}) DAY
          AND TIMESTAMP '{DAY}' + INTERVAL ({last}) DAY AND {condition} AND {NOT_ASSET}
          AND http_path NOT LIKE '/fr/1%'
        GROUP BY 1, 2, 3, 4 {having}"""


def _signature(code: int):
    name = SIGNATURES[code][0]
    # Ten rows in an hour are rare in small tables; spoofing needs least + 10.
    least = -8

    @query(name, signature_sql(code, least))
    def run(d):
        out = signature_detector(
            d.http_log, d.ip_ast, DAY, [code], [("http_path", "/fr/1%")], least
        )
        return attack_out(out)


for _code in SIGNATURES:
    _signature(_code)


@query(
    "d04_d09_all_signatures",
    " UNION ALL ".join(f"SELECT * FROM ({signature_sql(c, -8)})" for c in SIGNATURES),
)
def all_signatures(d):
    return attack_out(
        signature_detector(d.http_log, d.ip_ast, DAY, exclusions=[("http_path", "/fr/1%")], least=-8)
    )


ALERT_NAMES = {
    1: (ATTEMPT, ATTEMPT),
    2: ("attack_name LIKE '%SQL%'", "attack_name LIKE '%Inject%'"),
    4: ("attack_name LIKE '%Scan%'", "attack_name LIKE '%Scan%'"),
    5: ("attack_name LIKE '%HTTP%Brute Force%'", None),
    6: ("attack_name LIKE '%XSS%'", "attack_name LIKE '%XSS%'"),
}


WHOLE_URLS = whole_sql({c: url_chars_sql(c) for c in URL_COLUMNS}, False)


def alert_sql(least: int, offsets: dict) -> str:
    parts = []
    for code in range(1, 7):
        having, condition = "", SPOOFED
        if code == 3:
            having = f"HAVING count(*) >= {least + 10}"
        else:
            sources = [
                f"SELECT src_ip FROM {t} WHERE {c} GROUP BY 1 "
                f"HAVING count(src_ip) >= {least + offsets[code]}"
                for t, c in zip(("alert_block", "alert_waf"), ALERT_NAMES[code]) if c
            ]
            condition = f"src_ip IN ({' UNION '.join(sources)})"
        parts.append(f"""SELECT {code} AS code, date_trunc('hour', logtime) AS hour, src_ip, dst_ip,
            max(end_time) AS end_time, count(*) AS cnt, {method_sql()},
            {traffic_sql()}, {status_sql()}, {WHOLE_URLS}
            FROM http_log WHERE logtime BETWEEN TIMESTAMP '{DAY}'
              AND TIMESTAMP '{DAY}' + INTERVAL 31 DAY AND {condition} AND {NOT_ASSET}
            GROUP BY 1, 2, 3, 4 {having}""")
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def alert_out(profiles):
    return round_moments(profiles.rows).withColumnRenamed("lgtime", "hour")


@query("d10_alert_detectors", alert_sql(10, ALERT_OFFSETS))
def d10(d):
    return alert_out(alert_detector(d.http_log, d.alert_block, d.alert_waf, d.ip_ast, DAY))


LOW = {1: 110, 2: 62, 4: 64, 5: 64, 6: 64}


@query("d10_alert_detectors_low", alert_sql(-7, LOW))
def d10_low(d):
    return alert_out(
        alert_detector(
            d.http_log, d.alert_block, d.alert_waf, d.ip_ast, DAY, least=-7, offsets=LOW
        )
    )


@query(
    "d11_session_hijack",
    f"""SELECT hour, src_ip, max(end_time) AS end_time, count(*) AS cnt,
        {method_sql()}, {traffic_sql()}, {status_sql()},
        {whole_sql({c: url_chars_sql(c) for c in ("http_path", "http_query", "http_cookie")}, False)}
        FROM (SELECT *, date_trunc('hour', logtime) AS hour FROM http_log
              WHERE contains(http_cookie, 'SESSION') AND logtime >= TIMESTAMP '2024-01-03'
                AND {NOT_ASSET})
        GROUP BY 1, 2 HAVING count(*) > 0 AND count(DISTINCT http_path) = 1""",
)
def d11(d):
    return alert_out(hijack_detector(d.http_log, d.ip_ast, "2024-01-03 00:00:00", hits=0))


@query(
    "d12_asset_lookup",
    "SELECT DISTINCT src_ip, 1 AS asset FROM http_log WHERE src_ip IN (SELECT ip FROM ip_ast)",
)
def d12(d):
    return asset_lookup(d.http_log, d.ip_ast)


FEEDBACK_ROWS = """feedback f JOIN http_log l ON l.src_ip = f.src_ip AND l.logtime >= f.start_time
    AND l.end_time <= f.end_time WHERE f.model_id = 30 AND f.feedback <> -1"""
@query(
    "d13_http_feedback",
    f"""SELECT f.feedback_id, date_trunc('hour', l.logtime) AS hour, l.src_ip,
        max(l.end_time) AS end_time, count(*) AS cnt, {method_sql()},
        {traffic_sql()}, {status_sql()}, {WHOLE_URLS}, f.feedback
        FROM {FEEDBACK_ROWS} GROUP BY f.feedback_id, hour, l.src_ip, f.feedback""",
)
def d13(d):
    return alert_out(http_feedback(d.http_log, d.feedback, 30))


@query(
    "d13_http_feedback_light",
    f"""SELECT f.feedback_id, date_trunc('hour', l.logtime) AS hour, l.src_ip,
        max(l.end_time) AS end_time, count(*) AS cnt, {method_sql()}, {status_sql()}, f.feedback
        FROM {FEEDBACK_ROWS} GROUP BY f.feedback_id, hour, l.src_ip, f.feedback""",
)
def d13_light(d):
    return light_feedback(d.http_log, d.feedback, 30).withColumnRenamed("lgtime", "hour")


CLOCK_DEFAULTS = ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in CLOCK)


@query(
    "d13_dns_feedback",
    f"""SELECT p.*, {CLOCK_DEFAULTS} FROM (
          SELECT f.feedback_id, date_trunc('hour', l.logtime) AS hour, l.src_ip,
                 max(l.end_time) AS end_time, count(*) AS cnt,
                 round(avg(o), 6) AS global_osint, round(avg(g), 6) AS global_range,
                 {whole_sql({c: url_chars_sql(c) for c in ("dns_query", "dns_answer")}, False)}, f.feedback
          FROM hour_feedback f JOIN {INTEL} l ON l.src_ip = f.src_ip AND l.logtime >= f.start_time
               AND l.end_time <= f.end_time
          WHERE f.model_id = 40 AND f.feedback <> -1
          GROUP BY f.feedback_id, hour, l.src_ip, f.feedback, f.start_time, f.end_time
          HAVING date_trunc('hour', l.logtime) = f.start_time AND max(l.end_time) = f.end_time) p
        LEFT JOIN (SELECT src_ip, date_trunc('hour', logtime) AS hour, max(end_time) AS end_time,
                          {clock_sql()} FROM dns_log GROUP BY 1, 2) c
        ON c.src_ip = p.src_ip AND c.hour = p.hour AND c.end_time = p.end_time""",
)
def d13_dns(d):
    out = dns_feedback(d.dns_log, d.hour_feedback, d.osint, d.range_intel, 40).rows
    flags = {c: F.round(c, 6) for c in ("global_osint", "global_range")}
    return out.withColumns(flags).withColumnRenamed("lgtime", "hour")


@query(
    "d04_d09_signature_texts",
    " UNION ALL ".join(
        texts_sql(
            f"""(SELECT *, {code} AS code, date_trunc('hour', logtime) AS hour FROM {KEYWORD_LOG}
                WHERE logtime BETWEEN TIMESTAMP '{DAY}' + INTERVAL ({first}) DAY
                  AND TIMESTAMP '{DAY}' + INTERVAL ({last}) DAY AND {condition} AND {NOT_ASSET})""",
            "code, hour, src_ip, dst_ip", WORD_COLUMNS,
        )
        for code, (_, (first, last), condition) in SIGNATURES.items()
    ),
)
def signature_texts(d):
    """Keyword texts behind the signature alerts; one request an hour is enough here."""
    return signature_detector(d.http_log, d.ip_ast, DAY, least=-9).renamed({"lgtime": "hour"}).texts


@query(
    "d13_feedback_by_model",
    f"""SELECT f.feedback_id, date_trunc('hour', l.logtime) AS hour, l.src_ip, f.feedback, m.model_id,
        max(l.end_time) AS end_time, count(*) AS cnt, {method_sql()}, {status_sql()}
        FROM (SELECT * FROM feedback WHERE feedback <> -1) f
        JOIN http_log l ON l.src_ip = f.src_ip AND l.logtime >= f.start_time AND l.end_time <= f.end_time
        JOIN (SELECT 1 AS model_id UNION ALL SELECT 30) m ON true
        GROUP BY f.feedback_id, hour, l.src_ip, f.feedback, m.model_id""",
)
def d13_by_model(d):
    """The measures two models share, for verdicts filed under each of them."""
    found = []
    for model_id in (1, 30):
        verdicts = d.feedback.withColumn("model_id", F.lit(model_id))
        rows = model_feedback(model_id, verdicts, d.http_log, d.dns_log, d.osint, d.range_intel)
        found.append((rows if model_id == 1 else rows.measures).withColumn("model_id", F.lit(model_id)))
    return found[0].unionByName(found[1].select(*found[0].columns)).withColumnRenamed("lgtime", "hour")
