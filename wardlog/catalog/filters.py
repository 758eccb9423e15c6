"""Row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.registry import query
from wardlog.constants import CREDENTIAL_TERMS, INJECTION_TERMS, SCANNER_TERMS, SIGNATURES, XSS_TAG
from wardlog.operators import predicates as P
from wardlog.operators.joins import keep_listed
from wardlog.operators.windows import by_window

DAY = "2024-01-10"
EXCLUDED = [
    ("http_path", "/en/%"),
    ("http_query", "%page_2%"),
    ("http_host", "m.%"),
]


def signature_case() -> str:
    cases = " ".join(f"WHEN lower({c}) LIKE '{p}' THEN '{p}'" for c, p in SIGNATURES)
    return f"CASE {cases} END"


def regex(column: str, terms: list[str]) -> str:
    return f"regexp_matches(lower({column}), '{'|'.join(terms)}')"


INJECTION = regex("http_query", INJECTION_TERMS)
SCANNER = regex("http_agent", SCANNER_TERMS)
CREDENTIAL = regex("http_query", CREDENTIAL_TERMS)
XSS = f"(regexp_matches(lower(http_query), '{XSS_TAG.replace(chr(39), chr(39) * 2)}') AND http_query <> '-')"
SPOOFED = "(http_xfor <> src_ip AND http_xfor <> '-' AND http_xfor NOT LIKE '%,%')"
FILE_PROBE = f"(({signature_case()}) IS NOT NULL)"
ATTEMPT = """(attack_name LIKE '%attempt%' OR (attack_name LIKE '%Vulnerability%'
    AND attack_name NOT LIKE '%SQL%' AND attack_name NOT LIKE '%Scan%'))"""


def _where(name: str, condition: str, predicate, columns=("event_id", "logtime", "src_ip")):
    picked = ", ".join(columns)

    @query(name, f"SELECT {picked} FROM http_log WHERE {condition}")
    def run(d):
        return d.http_log.where(predicate()).select(*columns)


_where(
    "p01_time_range",
    "logtime BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'",
    lambda: P.in_range("logtime", "2024-01-05 00:00:00", "2024-01-09 12:00:00"),
)
_where("p04_has_text", "NOT (http_host = '' AND http_agent = '' AND http_query = '')", P.has_text)
_where("p05_ipv4", "src_ip LIKE '%.%.%.%'", P.is_ipv4)
_where("p07_injection", INJECTION, P.injection, ("event_id", "http_query"))
_where("p08_scanner", SCANNER, P.scanner, ("event_id", "http_agent"))
_where("p09_credential", CREDENTIAL, P.credential, ("event_id", "http_query"))
_where("p10_xss", XSS, P.xss, ("event_id", "http_query"))
_where("p11_spoofed", SPOOFED, P.spoofed, ("event_id", "src_ip", "http_xfor"))
_where(
    "p12_known_noise",
    "NOT (http_path LIKE '/en/%' OR http_query LIKE '%page_2%' OR http_host LIKE 'm.%')",
    lambda: ~P.known_noise(EXCLUDED),
    ("event_id", "http_host", "http_path"),
)
_where("p13_session_cookie", "contains(http_cookie, 'SESSION')", P.has_session,
       ("event_id", "http_cookie"))


@query(
    "p02_day_windows",
    "SELECT " + ", ".join(
        f"count(*) FILTER (WHERE logtime BETWEEN TIMESTAMP '{DAY}' + INTERVAL ({a}) DAY "
        f"AND TIMESTAMP '{DAY}' + INTERVAL ({b}) DAY) AS w{i}"
        for i, (a, b) in enumerate([(0, 31), (-31, 31), (0, 3), (0, 2), (-7, 0)])
    ) + " FROM http_log",
)
def p02(d):
    windows = [(0, 31), (-31, 31), (0, 3), (0, 2), (-7, 0)]
    return d.http_log.agg(
        *[F.count_if(P.in_days("logtime", DAY, a, b)).alias(f"w{i}")
          for i, (a, b) in enumerate(windows)]
    )


@query(
    "p03_log_day",
    f"SELECT event_id, client_ip, service_code FROM login_log WHERE logdate = DATE '{DAY}'",
)
def p03(d):
    return d.login_log.where(P.on_day("logdate", DAY)).select(
        "event_id", "client_ip", "service_code"
    )


@query(
    "p06_path_signatures",
    f"""SELECT event_id, http_path, http_query, matched_rule FROM (
          SELECT *, {signature_case()} AS matched_rule FROM http_log)
        WHERE matched_rule IS NOT NULL""",
)
def p06(d):
    rows = d.http_log.withColumn("matched_rule", P.matched_signature())
    return rows.where(F.col("matched_rule").isNotNull()).select(
        "event_id", "http_path", "http_query", "matched_rule"
    )


@query(
    "p14_listed_clients",
    "SELECT event_id, client_ip FROM login_log WHERE client_ip IN (SELECT ip FROM ip_ast)",
)
def p14(d):
    listed = keep_listed(d.login_log, d.ip_ast, "client_ip", "ip")
    return listed.select("event_id", "client_ip")


@query("p15_alert_names", f"SELECT src_ip, attack_name, logtime FROM alerts WHERE {ATTEMPT}")
def p15(d):
    rows = d.alerts.where(P.attempt_or_vulnerability())
    return rows.select("src_ip", "attack_name", "logtime")


@query(
    "p16_reviewed",
    "SELECT feedback_id, src_ip, feedback FROM feedback WHERE model_id = 30 AND feedback <> -1",
)
def p16(d):
    return d.feedback.where(P.reviewed(30)).select("feedback_id", "src_ip", "feedback")


@query(
    "p17_inside_window",
    """SELECT f.src_ip, f.start_time, count(*) AS n
       FROM (SELECT DISTINCT src_ip, start_time, end_time FROM feedback) f
       JOIN dns_log l ON l.src_ip = f.src_ip AND l.logtime >= f.start_time
                     AND l.end_time <= f.end_time GROUP BY 1, 2""",
)
def p17(d):
    count = lambda rows, keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    add = lambda parts, keys: parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    rows = by_window(d.dns_log, d.feedback, count, add)
    return rows.select("src_ip", F.col("window_start").alias("start_time"), "n")


@query(
    "p18_label_classes",
    """SELECT hash, count(*) AS n FROM http_log
       WHERE hash IN ('XSS', 'BEACONING', 'SQL_INJECTION', 'CREDENTIAL') GROUP BY 1""",
)
def p18(d):
    kinds = ("XSS", "BEACONING", "SQL_INJECTION", "CREDENTIAL")
    rows = d.http_log.where(F.col("hash").isin(*kinds))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p19_score_gates",
    """SELECT event_id, (credential <= 0.5 AND file_download <= 0.5 AND injection <= 0.5
              AND xss <= 0.5) AS quiet, normal > 0.3 AS above FROM class_scores""",
)
def p19(d):
    attacks = ("credential", "file_download", "injection", "xss")
    quiet = F.greatest(*[F.col(c) for c in attacks]) <= 0.5
    return d.class_scores.select(
        "event_id", quiet.alias("quiet"), (F.col("normal") > 0.3).alias("above")
    )
