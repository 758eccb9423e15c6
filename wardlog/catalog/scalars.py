"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.registry import clean_sql, query, url_chars_sql
from wardlog.catalog.aggregates import AGENT_WORDS, PATH_WORDS, QUERY_WORDS
from wardlog.functions import text, times, vectors
from wardlog.sources.sinks import row_id


def _on(name: str, table: str, key: str, sql: dict[str, str], columns):
    """A projection of one table, checked column by column."""
    picked = ", ".join(f"{v} AS {k}" for k, v in sql.items())

    @query(name, f"SELECT {key}, {picked} FROM {table}")
    def run(d):
        out = columns()
        return getattr(d, table).select(key, *[c.alias(n) for n, c in out.items()])


_on("f01_if", "http_log", "event_id",
    {"kind": "CASE WHEN dst_port < 1024 THEN 'low' ELSE 'high' END"},
    lambda: {"kind": F.when(F.col("dst_port") < 1024, "low").otherwise("high")})
_on("f02_to_string", "http_log", "event_id", {"port": "CAST(dst_port AS VARCHAR)"},
    lambda: {"port": F.col("dst_port").cast("string")})
_on("f03_literal_found", "http_log", "event_id",
    {"ten": "contains(http_retcode, '10')", "get": "contains(http_method, 'GET')"},
    lambda: {"ten": text.has_literal(F.col("http_retcode"), "10"),
             "get": text.has_literal(F.col("http_method"), "GET")})
_on("f04_keep_characters", "pages", "page_id", {"url": url_chars_sql("url")},
    lambda: {"url": text.url_chars(F.col("url"))})
_on("f04_clean_documents", "documents", "doc_id", {"clean": clean_sql("text")},
    lambda: {"clean": text.payload_words(F.col("text"))})
_on("f05_pattern_found", "documents", "doc_id",
    {"hit": "regexp_matches(lower(text), 'user_pass|user_login|user_id|userid%passwd|the ')"},
    lambda: {"hit": text.any_of(F.col("text"), ["user_pass", "user_login", "user_id",
                                                 "userid%passwd", "the "])})
_on("f06_replace_all", "pages", "page_id",
    {"marked": "replace(url, '.', ' ddott ')", "host": "replace(lower(url), '.', ' ')"},
    lambda: {"marked": F.replace(F.col("url"), F.lit("."), F.lit(" ddott ")),
             "host": text.host_keywords(F.col("url"))})
_on("f07_blank_marks", "documents", "doc_id",
    {"out": "regexp_replace(text, '[%/!@#$?,;:&*)(-+=]', ' ', 'g')"},
    lambda: {"out": text.blank_out(F.col("text"), text.PAYLOAD_MARKS)})
_on("f08_keywords", "http_log", "event_id",
    {"path": PATH_WORDS, "query": QUERY_WORDS, "agent": AGENT_WORDS},
    lambda: {"path": text.path_keywords(F.col("http_path")),
             "query": text.query_keywords(F.col("http_query")),
             "agent": text.agent_keywords(F.col("http_agent"))})
_on("f09_lower", "documents", "doc_id", {"low": "lower(text)"}, lambda: {"low": F.lower("text")})
_on("f10_like", "http_log", "event_id",
    {"v4": "src_ip LIKE '%.%.%.%'", "php": "lower(http_path) LIKE '%.html'",
     "single": "http_xfor NOT LIKE '%,%'"},
    lambda: {"v4": F.col("src_ip").like("%.%.%.%"),
             "php": F.lower("http_path").endswith(".html"),
             "single": ~F.col("http_xfor").like("%,%")})
_on("f11_byte_length", "documents", "doc_id", {"bytes": "strlen(text)"},
    lambda: {"bytes": F.octet_length("text").cast("bigint")})
_on("f12_dates", "events", "event_id",
    {"at": "CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)", "day": "CAST(ts AS DATE)",
     "later": "CAST(CAST(ts AS DATE) + 31 AS TIMESTAMP)",
     "before": "CAST(CAST(ts AS DATE) - 7 AS TIMESTAMP)"},
    lambda: {"at": F.date_format("ts", "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz"),
             "day": F.to_date("ts"), "later": times.day_start(F.col("ts"), 31),
             "before": times.day_start(F.col("ts"), -7)})
UNITS = ["minute", "hour", "day", "month", "quarter", "year"]
_on("f13_start_of", "events", "event_id",
    {**{f"at_{u}": f"CAST(date_trunc('{u}', ts) AS TIMESTAMP)" for u in UNITS},
     "at_5minute": "time_bucket(INTERVAL 5 MINUTE, ts)",
     "at_15minute": "time_bucket(INTERVAL 15 MINUTE, ts)"},
    lambda: {f"at_{u}": times.start_of(u, F.col("ts")) for u in [*UNITS, "5minute", "15minute"]})
CRON = """CASE event_type WHEN 'view' THEN '*/5 * * * *' WHEN 'click' THEN '0 */1 * * *'
    WHEN 'signup' THEN '* * * * *' WHEN 'purchase' THEN '0 0 1 */1 *' ELSE concat('x', event_id) END"""


@query(
    "f13_cron_unit",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '5minute' WHEN 'click' THEN 'hour'
       WHEN 'signup' THEN 'minute' WHEN 'purchase' THEN 'month' ELSE 'hour' END AS unit FROM events""",
)
def f13_cron(d):
    rows = d.events.withColumn("cron", F.expr(CRON))
    return rows.select("event_id", times.cron_unit(F.col("cron")).alias("unit"))


_on("f14_hour_and_weekday", "events", "event_id",
    {"hour": "CAST(hour(ts) AS INT)", "weekday": "CAST(isodow(ts) AS INT)"},
    lambda: {"hour": F.hour("ts"), "weekday": times.monday_first(F.col("ts"))})
_on("f15_day_number", "events", "event_id", {"logdate": "CAST(strftime(ts, '%Y%m%d') AS INT)"},
    lambda: {"logdate": times.day_number(F.col("ts"))})
_on("f16_row_id", "events", "event_id",
    {"id": "md5(concat_ws('|', CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type))"},
    lambda: {"id": row_id(["user_id", "ts", "event_type"], ["ts"])})


@query("f16_engine_hash")
def f16_engine(d):
    return d.events.select("event_id", F.xxhash64("user_id", "ts", "event_type").alias("hash"))


_on("f17_arithmetic", "events", "event_id",
    {"square": "round(pow(value, 2), 4)", "root": "round(pow(value, 0.5), 6)",
     "share": "round(value / 7, 6)"},
    lambda: {"square": F.round(F.pow("value", F.lit(2)), 4), "root": F.round(F.sqrt("value"), 6),
             "share": F.round(F.col("value") / 7, 6)})
_on("f18_arrays", "embeddings", "vec_id",
    {"diffs": "round(list_sum(list_transform(embedding[2:], lambda v, i: CAST(v AS DOUBLE) - embedding[i])), 5)",
     "places": "len(embedding)", "tail": "len(embedding[2:])",
     "total": "round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6)",
     "empty": "len(list_filter(embedding, lambda v: v > 1e9)) = 0",
     "same": "len(list_filter(embedding, lambda v: v = embedding[1]))",
     "kinds": "len(list_distinct(list_transform(embedding, lambda v: floor(v * 4))))",
     "text": "array_to_string(list_transform(embedding, lambda v: CAST(CAST(floor(v * 4) AS BIGINT) AS VARCHAR)), ',')"},
    lambda: _array_columns())


def _array_columns():
    e = F.col("embedding").cast("array<double>")
    steps = F.transform(F.col("embedding"), lambda v: F.floor(v * 4))
    tail = F.slice(e, 2, F.size(e) - 1)
    diffs = F.transform(
        F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.get(e, i) - F.get(e, i - 1)
    )
    return {
        "diffs": F.round(vectors.total(diffs), 5),
        "places": F.size(F.sequence(F.lit(1), F.size(e))).cast("bigint"),
        "tail": F.size(tail).cast("bigint"),
        "total": F.round(vectors.total(e), 6),
        "empty": F.size(F.filter(e, lambda v: v > 1e9)) == 0,
        "same": vectors.count_equal(e, F.get(e, F.lit(0))).cast("bigint"),
        "kinds": F.size(F.array_distinct(steps)).cast("bigint"),
        "text": F.array_join(steps.cast("array<string>"), ","),
    }


_on("f19_class_c", "dns_log", "event_id",
    {"range": "concat(regexp_replace(dns_answer, '[.][0-9]+$', ''), '.xxx')"},
    lambda: {"range": vectors.class_c(F.col("dns_answer"))})
SPANS = """CASE event_type WHEN 'view' THEN concat('hours=', CAST(user_id AS STRING))
    WHEN 'click' THEN concat('minutes=', CAST(user_id AS STRING)) WHEN 'signup' THEN 'weeks=8'
    WHEN 'purchase' THEN concat('years=', CAST(user_id AS STRING)) ELSE 'days' END"""


@query(
    "f20_durations",
    """SELECT event_id, CASE event_type WHEN 'view' THEN user_id * 3600 WHEN 'click' THEN user_id * 60
       WHEN 'signup' THEN 8 * 604800 ELSE 86400 END AS seconds FROM events""",
)
def f20(d):
    rows = d.events.withColumn("span", F.expr(SPANS))
    return rows.select("event_id", times.duration_seconds(F.col("span")).alias("seconds"))


@query(
    "f21_run_windows",
    """SELECT event_id, e AS logtime_e, e - INTERVAL 3 HOUR AS logtime_s,
              strftime(e - INTERVAL 3 HOUR, '%Y-%m-%d') AS logdate_s,
              strftime(e, '%Y-%m-%d') AS logdate_e,
              strftime(e - INTERVAL 56 DAY, '%Y-%m-%d') AS logdate_m,
              strftime(e - INTERVAL 1 DAY, '%Y-%m-%d') AS logdate_day
       FROM (SELECT event_id, ts + INTERVAL 9 HOUR - to_minutes(user_id) AS e FROM events)""",
)
def f21(d):
    rows = d.events.select(
        "event_id", F.col("ts").alias("now"),
        F.concat(F.lit("minutes="), F.col("user_id").cast("string")).alias("back"),
        F.lit("hours=3").alias("span"),
    )
    return times.run_window(rows, "now", "back", "span").drop("now", "back", "span")



@query(
    "f22_after_bracket",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN event_type ELSE concat(event_type, ')x') END
       AS label FROM events""",
)
def f22(d):
    raw = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(
        F.concat(F.lit("(12)"), F.col("event_type"), F.lit(")x"))
    )
    return d.events.select("event_id", text.after_bracket(raw).alias("label"))


_on("f23_label_names", "scores", "event_id",
    {"name": """CASE route WHEN 'injection' THEN 'SQL_INJECTION' WHEN 'xss' THEN 'XSS'
        WHEN 'file_download' THEN 'FILE_DOWNLOAD' WHEN 'credential' THEN 'CREDENTIAL'
        ELSE 'NORMAL' END""",
     "code": """CAST(CASE route WHEN 'injection' THEN 33402 WHEN 'xss' THEN 33403
        WHEN 'file_download' THEN 33404 WHEN 'credential' THEN 33401 ELSE 33400 END AS BIGINT)"""},
    lambda: {"name": vectors.display_name(F.col("route")),
             "code": vectors.result_code(vectors.display_name(F.col("route")), 334)})
_on("f24_row_rmse", "embeddings", "vec_id",
    {"rmse": """round(sqrt(list_avg(list_transform(embedding,
        lambda v, i: pow(CAST(v AS DOUBLE) - embedding[len(embedding) + 1 - i], 2)))), 6)"""},
    lambda: {"rmse": F.round(vectors.rmse(F.col("embedding"), F.reverse("embedding")), 6)})
_on("f25_run_stamps", "events", "event_id",
    {"weekday": "CAST(isodow(ts) - 1 AS VARCHAR)", "dayhour": "strftime(ts, '%H')"},
    lambda: {"weekday": F.weekday("ts").cast("string"), "dayhour": F.date_format("ts", "HH")})
