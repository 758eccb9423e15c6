"""Aggregations and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.registry import (
    HAS_TEXT,
    clean_sql,
    clock_sql,
    digest_sql,
    joined_sql,
    method_sql,
    query,
    ratio,
    status_sql,
    texts_sql,
    traffic_sql,
    url_chars_sql,
    whole_sql,
)
from wardlog.functions.text import agent_keywords, path_keywords, payload_words, query_keywords
from wardlog.operators import profiles as pf
from wardlog.operators.ordering import gap_statistics
from wardlog.operators.predicates import in_days
from wardlog.plans.detectors import (
    attack_profile,
    by_hour,
    hijack_candidates,
    traffic_numbers,
    traffic_profile,
)
from wardlog.plans.dns import (
    CLOCK,
    dns_profile,
    group_profile,
    hit_rates,
    mean_group_profile,
    rareness,
)
from wardlog.plans.extraction import TEXTS, prediction_rows
from wardlog.plans.logins import RATIOS, login_profile, outcome_counts, service_shares

WIDE_TIMES = ("2024-01-01 00:00:00", "2024-02-01 00:00:00")
PROFILE_SQL = f"""max(end_time) AS "end", count(DISTINCT dst_port) AS dst_port_cnt, {status_sql()},
    {whole_sql({'agent_': clean_sql('http_agent'), 'query_': clean_sql('http_query')})}"""

# The same normalisers as the engine's, in the checking engine's dialect.
PATH_WORDS = "regexp_replace(lower(http_path), '[/.,/-?!@#$%^&/_]', ' ', 'g')"
QUERY_WORDS = "regexp_replace(lower(http_query), '[/.0-9,=:/?!@#$%^&/_]', ' ', 'g')"
AGENT_WORDS = "regexp_replace(lower(http_agent), '[/. ,/-?!@#$%^&/_()]', ' ', 'g')"
KEYWORD_LOG = f"""(SELECT *, {PATH_WORDS} AS path, {QUERY_WORDS} AS query, {AGENT_WORDS} AS agent,
    CAST(dst_port AS VARCHAR) AS port FROM http_log)"""
PORTS = ", ".join(f"{ratio(f'length(CAST(dst_port AS VARCHAR)) = {n}')} AS port_{n}" for n in range(1, 6))
SPREAD = ", ".join(f"round(entropy({c}), 6) AS {c}_ent" for c in ("port", "path", "query", "agent"))
KINDS = ", ".join(f"count(DISTINCT {c}) AS {c}_len" for c in ("path", "query", "agent"))
WORD_COLUMNS = {"path": "path", "query": "query", "agent": "agent"}
ATTACK_SQL = f"""max(end_time) AS end_time, CAST(length(CAST(count(*) AS VARCHAR)) AS BIGINT) AS cnt,
    count(*) AS requests, {method_sql()}, {PORTS}, {SPREAD},
    count(DISTINCT port) AS uniq_dst_port,
    {", ".join(f"round(avg(strlen({c})), 6) AS {c}_uni" for c in ("path", "query", "agent"))},
    {", ".join(digest_sql(c, c) for c in WORD_COLUMNS)},
    {", ".join(f"{joined_sql(c)} AS {c}_keywords" for c in WORD_COLUMNS)}"""


def rounded(df, digits=6):
    """Doubles rounded, as the two engines add in different orders."""
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in doubles})


def attack_out(profiles):
    df = profiles.rows
    spread = [c for c in df.columns if c.endswith(("_ent", "_uni"))]
    names = {"lgtime": "hour", **{c: f"{c}_keywords" for c in WORD_COLUMNS}}
    return df.withColumns({c: F.round(c, 6) for c in spread}).withColumnsRenamed(names)


@query(
    "a01_http_profile",
    f"""SELECT logtime, src_ip, dst_ip, {PROFILE_SQL} FROM http_log
        WHERE logtime BETWEEN TIMESTAMP '{WIDE_TIMES[0]}' AND TIMESTAMP '{WIDE_TIMES[1]}'
          AND {HAS_TEXT} GROUP BY 1, 2, 3""",
)
def a01(d):
    return prediction_rows(d.http_log, *WIDE_TIMES).rows


@query(
    "a02_hourly_attack_profile",
    f"""SELECT date_trunc('hour', logtime) AS hour, src_ip, dst_ip,
        {ATTACK_SQL} FROM {KEYWORD_LOG} GROUP BY 1, 2, 3""",
)
def a02(d):
    return attack_out(attack_profile(by_hour(d.http_log)))


@query(
    "a03_traffic_profile",
    f"""SELECT date_trunc('hour', logtime) AS hour, src_ip, dst_ip, max(end_time) AS end_time,
        count(*) AS cnt, {method_sql()}, {traffic_sql()}, {status_sql()}
        FROM http_log GROUP BY 1, 2, 3""",
)
def a03(d):
    out = traffic_numbers(by_hour(d.http_log))
    return round_moments(out).withColumnRenamed("lgtime", "hour")


def round_moments(df, digits=4):
    names = [c for c in df.columns if c.startswith(("req_", "resp_"))]
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(
    "a03_traffic_profile_by_source",
    f"""SELECT date_trunc('hour', logtime) AS hour, src_ip, max(end_time) AS end_time,
        count(*) AS cnt, {method_sql()}, {traffic_sql()}, {status_sql()}
        FROM http_log GROUP BY 1, 2""",
)
def a03_source(d):
    out = traffic_numbers(by_hour(d.http_log), ["lgtime", "src_ip"])
    return round_moments(out).withColumnRenamed("lgtime", "hour")


def _per_source(name: str, sql: str, measures):
    @query(name, f"SELECT src_ip, {sql} FROM http_log GROUP BY 1")
    def run(d):
        return d.http_log.groupBy("src_ip").agg(*[c.alias(n) for n, c in measures().items()])


_per_source("a04_last_end", "max(end_time) AS last_end", lambda: {"last_end": F.max("end_time")})
_per_source("a05_requests", "count(*) AS cnt", lambda: {"cnt": F.count(F.lit(1))})
_per_source("a06_distinct_ports", "count(DISTINCT dst_port) AS ports",
            lambda: {"ports": pf.distinct_ports()})
_per_source("a07_status_ratios", status_sql(), pf.status_ratios)
_per_source("a07_status_ratios_dash", status_sql("-"), lambda: pf.status_ratios(missing="-"))
_per_source("a08_method_ratios", method_sql(), pf.method_ratios)
_per_source("a09_port_digits", PORTS, pf.port_digits)
_per_source("a16_mean_bytes", "round(avg(strlen(http_agent)), 6) AS agent_bytes",
            lambda: {"agent_bytes": F.round(F.avg(F.octet_length("http_agent")), 6)})
_per_source("a17_magnitude", "CAST(length(CAST(count(*) AS VARCHAR)) AS BIGINT) AS cnt",
            lambda: {"cnt": F.length(F.count(F.lit(1)).cast("string")).cast("bigint")})


@query(
    "a10_entropy",
    f"""SELECT src_ip, dst_ip, {SPREAD} FROM {KEYWORD_LOG} GROUP BY 1, 2""",
)
def a10(d):
    columns = {
        "port": F.col("dst_port"), "path": path_keywords(F.col("http_path")),
        "query": query_keywords(F.col("http_query")), "agent": agent_keywords(F.col("http_agent")),
    }
    out = pf.value_spread(d.http_log, ["src_ip", "dst_ip"], columns)
    return rounded(out.drop(*[f"{n}_kinds" for n in columns]))


@query(
    "a11_traffic_moments",
    f"SELECT src_ip, dst_ip, {traffic_sql(3)} FROM http_log GROUP BY 1, 2",
)
def a11(d):
    out = d.http_log.groupBy("src_ip", "dst_ip").agg(
        *[c.alias(n) for n, c in pf.traffic_moments().items()]
    )
    return round_moments(out, 3)


URL_COLUMNS = ("http_host", "http_path", "http_query")


@query(
    "a12_cleaned_texts",
    f"""SELECT logtime, src_ip, {whole_sql({"agent_": clean_sql("http_agent"), "query_": clean_sql("http_query")})}
        FROM http_log GROUP BY 1, 2""",
)
def a12(d):
    texts = pf.cleaned_texts(TEXTS, payload_words, distinct=True)
    return pf.profile(d.http_log, ["logtime", "src_ip"], texts).rows


@query(
    "a12_cleaned_text_rows",
    texts_sql("http_log", "logtime, src_ip", {"agent_": clean_sql("http_agent"), "query_": clean_sql("http_query")}),
)
def a12_rows(d):
    texts = pf.cleaned_texts(TEXTS, payload_words, distinct=True)
    return pf.profile(d.http_log, ["logtime", "src_ip"], texts).texts


@query(
    "a13_all_texts",
    f"""SELECT logtime, src_ip, count(*) AS cnt, {whole_sql({c: url_chars_sql(c) for c in URL_COLUMNS}, False)}
        FROM http_log GROUP BY 1, 2""",
)
def a13(d):
    out = traffic_profile(d.http_log, ["logtime", "src_ip"])
    wanted = [f"{c}{end}" for c in URL_COLUMNS for end in ("", "_texts", "_digest")]
    return out.rows.select("logtime", "src_ip", "cnt", *wanted)


@query(
    "a13_all_text_rows",
    texts_sql("http_log", "logtime, src_ip", {c: url_chars_sql(c) for c in URL_COLUMNS}, distinct=False),
)
def a13_rows(d):
    return traffic_profile(d.http_log, ["logtime", "src_ip"]).texts


@query(
    "a13_text_digests",
    f"""SELECT logtime, src_ip, max(end_time) AS end_time, count(*) AS cnt, {traffic_sql()}, {method_sql()},
        {status_sql()}, {", ".join(digest_sql(url_chars_sql(c), c, False) for c in URL_COLUMNS)}
        FROM http_log GROUP BY 1, 2""",
)
def a13_digests(d):
    return round_moments(traffic_profile(d.http_log, ["logtime", "src_ip"]).measures)


@query("a14_distinct_keywords", texts_sql(KEYWORD_LOG, "logtime, src_ip", WORD_COLUMNS))
def a14(d):
    return attack_profile(d.http_log, ["logtime", "src_ip"]).texts


@query("a15_keyword_kinds", f"SELECT src_ip, dst_ip, {KINDS} FROM {KEYWORD_LOG} GROUP BY 1, 2")
def a15(d):
    columns = {
        "path": path_keywords(F.col("http_path")), "query": query_keywords(F.col("http_query")),
        "agent": agent_keywords(F.col("http_agent")),
    }
    out = pf.value_spread(d.http_log, ["src_ip", "dst_ip"], columns)
    return out.select("src_ip", "dst_ip", *[F.col(f"{n}_kinds").alias(f"{n}_len") for n in columns])


SERVICES = {
    "a_service": "service_code = 'A1000'",
    "h_service": "service_code = 'H1001'",
    "other_service": "service_code NOT IN ('A1000', 'H1001')",
}
SERVICE_SQL = ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {n}_total, "
    f"count(*) FILTER (WHERE {c} AND result = 0) AS {n}_success" for n, c in SERVICES.items()
)
RATIO_SQL = ", ".join(
    f"count(*) FILTER (WHERE {c} AND result = {r}) / CAST(count(*) AS DOUBLE) AS {n.split('_')[0]}_{s}_ratio"
    for r, s in ((0, "s"), (1, "f")) for n, c in SERVICES.items()
)


@query(
    "a18_service_counts",
    f"""SELECT client_ip, count(*) AS eflog_total_cnt, {SERVICE_SQL},
        count(*) FILTER (WHERE result = 0) AS success FROM login_log GROUP BY 1""",
)
def a18(d):
    return d.login_log.groupBy("client_ip").agg(
        *[c.alias(n) for n, c in pf.service_counts().items()]
    )


@query("a19_service_shares", f"SELECT client_ip, {RATIO_SQL} FROM login_log GROUP BY 1")
def a19(d):
    return service_shares(d.login_log).select("client_ip", *RATIOS)


OUTCOME_SQL = ", ".join(
    f"count(*) FILTER (WHERE service_code = '{c}' AND result = {r}) AS {c}_{r}"
    for c in ("H0015", "H0020", "H1001", "H5010", "A1000") for r in (0, 1)
)


@query(
    "a20_login_outcomes",
    f"""SELECT client_ip, {OUTCOME_SQL} FROM login_log
        WHERE logtime BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def a20(d):
    return outcome_counts(d.login_log, "2024-01-20")


@query("a21_hour_ratios", "SELECT src_ip, " + ", ".join(
    f"{ratio(f'hour(logtime) = {h}')} AS hour_{h}" for h in range(24)
) + " FROM dns_log GROUP BY 1")
def a21(d):
    return d.dns_log.groupBy("src_ip").agg(*[c.alias(n) for n, c in pf.hour_ratios().items()])


@query("a22_weekday_ratios", "SELECT src_ip, " + ", ".join(
    f"{ratio(f'isodow(logtime) = {n}')} AS day_{n}" for n in range(1, 8)
) + " FROM dns_log GROUP BY 1")
def a22(d):
    return d.dns_log.groupBy("src_ip").agg(*[c.alias(n) for n, c in pf.weekday_ratios().items()])


@query(
    "a23_thresholds",
    """SELECT src_ip, http_path, count(*) AS n FROM http_log GROUP BY 1, 2
       HAVING count(*) >= 10 AND count(DISTINCT http_method) > 1 AND max(dst_port) > 100""",
)
def a23(d):
    mixed = F.min("http_method") < F.max("http_method")
    out = d.http_log.groupBy("src_ip", "http_path").agg(
        F.count(F.lit(1)).alias("n"), mixed.alias("mixed"), F.max("dst_port").alias("port")
    )
    return out.where("n >= 10 AND mixed AND port > 100").select("src_ip", "http_path", "n")


RARE_SQL = """SELECT {keys} avg(r.rareness) AS rareness FROM
    (SELECT * FROM dns_log WHERE src_ip IN (SELECT ip FROM ip_ast)) w JOIN
    (SELECT dns_query, count(*) / CAST((SELECT count(*) FROM dns_log) AS DOUBLE) AS rareness
     FROM dns_log GROUP BY 1) r ON r.dns_query = w.dns_query"""


@query(
    "a24_domain_rareness",
    f"SELECT round(rareness, 9) AS rareness FROM ({RARE_SQL.format(keys='')})",
)
def a24(d):
    wanted = d.dns_log.join(d.ip_ast.withColumnRenamed("ip", "src_ip"), "src_ip", "left_semi")
    return rounded(rareness(d.dns_log, wanted), 9)


INTEL = """(SELECT *, CAST(dns_query IN (SELECT target FROM osint) AS INT) AS o,
    regexp_replace(src_ip, '[.][0-9]+$', '.xxx') AS ip_range,
    CAST(regexp_replace(src_ip, '[.][0-9]+$', '.xxx') IN (
        SELECT regexp_replace(range_start, '[.][0-9]+$', '.xxx') FROM range_intel) AS INT) AS g
    FROM dns_log)"""


@query(
    "a25_intel_hit_rates",
    f"""SELECT round(avg(o), 9) AS global_osint, round(avg(g), 9) AS global_range FROM (
        SELECT avg(o) AS o, avg(g) AS g FROM {INTEL} WHERE src_ip LIKE '10.%' GROUP BY ip_range)""",
)
def a25(d):
    wanted = d.dns_log.where(F.col("src_ip").like("10.%"))
    return rounded(hit_rates(wanted, d.osint, d.range_intel), 9)


GAPS_SQL = """SELECT client_ip, count(*) AS events, coalesce(avg(gap), 0) AS diff_avg,
    coalesce(round(stddev_pop(gap), 2), 0) AS diff_std FROM (
      SELECT client_ip, epoch(logtime) - lag(epoch(logtime)) OVER (
             PARTITION BY client_ip ORDER BY logtime, event_id) AS gap FROM login_log)
    GROUP BY 1"""


@query("a26_gap_statistics", f"SELECT * REPLACE (round(diff_avg, 6) AS diff_avg) FROM ({GAPS_SQL})")
def a26(d):
    return gap_statistics(d.login_log, "client_ip", "logtime").withColumn(
        "diff_avg", F.round("diff_avg", 6)
    )


@query("a27_distinct_keys", "SELECT DISTINCT src_ip, dst_ip FROM http_log")
def a27(d):
    return d.http_log.select("src_ip", "dst_ip").distinct()


@query(
    "a28_login_profile",
    f"""SELECT g.client_ip, r.* EXCLUDE (client_ip), round(g.diff_avg, 6) AS diff_avg, g.diff_std
        FROM ({GAPS_SQL}) g LEFT JOIN (SELECT client_ip, {RATIO_SQL} FROM login_log GROUP BY 1) r
        ON r.client_ip = g.client_ip""",
)
def a28(d):
    return login_profile(d.login_log).withColumn("diff_avg", F.round("diff_avg", 6))


DAY_LOGINS = """(SELECT * FROM login_log WHERE logdate = DATE '2024-01-15'
    AND client_ip IN (SELECT ip FROM ip_ast))"""


@query(
    "a28_login_profile_of_day",
    f"""SELECT g.client_ip, r.* EXCLUDE (client_ip), round(g.diff_avg, 6) AS diff_avg, g.diff_std
        FROM ({GAPS_SQL.replace('FROM login_log', f'FROM {DAY_LOGINS}')}) g
        LEFT JOIN (SELECT client_ip, {RATIO_SQL} FROM {DAY_LOGINS} GROUP BY 1) r
        ON r.client_ip = g.client_ip""",
)
def a28_day(d):
    wanted = d.ip_ast.withColumnRenamed("ip", "client_ip")
    out = login_profile(d.login_log, "2024-01-15", wanted)
    return out.withColumn("diff_avg", F.round("diff_avg", 6))


@query(
    "a29_dns_profile",
    f"""SELECT date_trunc('hour', logtime) AS hour, src_ip,
        max(end_time) AS end_time, count(*) AS cnt, round(avg(o), 6) AS global_osint,
        round(avg(g), 6) AS global_range, {clock_sql()},
        {whole_sql({c: url_chars_sql(c) for c in ('dns_query', 'dns_answer')}, False)} FROM {INTEL} GROUP BY 1, 2""",
)
def a29(d):
    out = dns_profile(d.dns_log, d.osint, d.range_intel).rows
    return out.withColumnRenamed("lgtime", "hour").withColumns(
        {c: F.round(c, 6) for c in ("global_osint", "global_range")}
    )


@query(
    "a29_dns_texts",
    texts_sql(
        "(SELECT *, date_trunc('hour', logtime) AS hour FROM dns_log)", "hour, src_ip",
        {c: url_chars_sql(c) for c in ("dns_query", "dns_answer")}, distinct=False,
    ),
)
def a29_texts(d):
    return dns_profile(d.dns_log, d.osint, d.range_intel).renamed({"lgtime": "hour"}).texts


GROUP_SQL = f"""
    SELECT c.*, r.rareness, h.global_osint, h.global_range FROM
      (SELECT {{key}} AS {{name}}, count(*) AS cnt, {clock_sql()}, entropy(dns_query) AS dns_query_ent
       FROM dns_log WHERE {{where}} GROUP BY 1) c
    JOIN (SELECT {{key}} AS {{name}}, avg(rareness) AS rareness FROM dns_log w JOIN
          (SELECT dns_query AS q, count(*) / CAST((SELECT count(*) FROM dns_log) AS DOUBLE) AS rareness
           FROM dns_log GROUP BY 1) ON q = w.dns_query WHERE {{where}} GROUP BY 1) r USING ({{name}})
    JOIN (SELECT {{name}}, avg(o) AS global_osint, avg(g) AS global_range FROM
          (SELECT {{key}} AS {{name}}, ip_range, avg(o) AS o, avg(g) AS g FROM {INTEL}
           WHERE {{where}} GROUP BY 1, 2) GROUP BY 1) h USING ({{name}})"""
ROUND_GROUP = """round(dns_query_ent, 6) AS dns_query_ent, round(rareness, 9) AS rareness,
    round(global_osint, 6) AS global_osint, round(global_range, 6) AS global_range"""


@query(
    "a30_dns_group_profile",
    f"SELECT * REPLACE ({ROUND_GROUP}) FROM ("
    + GROUP_SQL.format(key="1", name="idx", where="src_ip LIKE '10.%'") + ")",
)
def a30(d):
    wanted = d.dns_log.where(F.col("src_ip").like("10.%"))
    out = group_profile(d.dns_log, wanted, d.osint, d.range_intel).withColumn("idx", F.lit(1))
    return _round_group(out)


def _round_group(df):
    digits = {"dns_query_ent": 6, "rareness": 9, "global_osint": 6, "global_range": 6}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


GROUP_DIGITS = {
    "cnt": 6, **{c: 9 for c in CLOCK}, "dns_query_ent": 6, "rareness": 9, "global_osint": 6, "global_range": 6,
}


@query(
    "a31_mean_of_batches",
    "SELECT " + ", ".join(f"round(avg({c}), {n}) AS {c}" for c, n in GROUP_DIGITS.items()) + " FROM ("
    + GROUP_SQL.format(key="right(src_ip, 1)", name="batch", where="true") + ")",
)
def a31(d):
    log = d.dns_log.withColumn("batch", F.right("src_ip", F.lit(1)))
    per_batch = group_profile(d.dns_log, log, d.osint, d.range_intel, ["batch"])
    out = mean_group_profile(per_batch, ["batch"])
    return out.select(*[F.round(c, n).alias(c) for c, n in GROUP_DIGITS.items()])


@query("a32_label_counts", "SELECT hash AS label, count(*) AS n FROM http_log GROUP BY 1")
def a32(d):
    return d.http_log.groupBy(F.col("hash").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a33_hijack_candidates",
    f"""SELECT hour, src_ip, max(end_time) AS end_time, count(*) AS cnt,
        {method_sql()}, {traffic_sql()}, {status_sql()},
        {whole_sql({'http_query': url_chars_sql('http_query')}, False)}
        FROM (SELECT *, date_trunc('hour', logtime) AS hour FROM http_log
              WHERE contains(http_cookie, 'SESSION'))
        GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT http_path) = 1""",
)
def a33(d):
    out = hijack_candidates(d.http_log, hits=1, texts=["http_query"])
    return round_moments(out.rows).withColumnRenamed("lgtime", "hour")


@query(
    "a23_one_day_window",
    f"""SELECT client_ip, count(*) AS n FROM login_log
        WHERE logtime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08'
        GROUP BY 1 HAVING count(client_ip) >= 20""",
)
def a23_window(d):
    rows = d.login_log.where(in_days("logtime", "2024-01-05", 0, 3))
    return rows.groupBy("client_ip").agg(F.count("client_ip").alias("n")).where("n >= 20")
