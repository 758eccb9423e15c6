"""Query registration and shared SQL fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.constants import METHODS, STATUS_MARKS
from wardlog.session import configure
from wardlog.sources.views import Data, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(data) -> DataFrame`` under a name, with its checking SQL."""

    def add(fn):
        def run(spark, folder):
            return fn(Data(configure(spark), folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(sql)
        return fn

    return add


def listed(df, key: str, places, scores):
    """Number arrays as texts of whole numbers, scores in millionths."""
    whole = F.transform(scores, lambda s: F.round(s * 1_000_000).cast("bigint"))
    return df.select(
        key,
        F.array_join(places.cast("array<bigint>"), ",").alias("place"),
        F.array_join(whole, ",").alias("score"),
    )


def ratio(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def status_sql(missing: str = "") -> str:
    marks = [f"{ratio(f"contains(http_retcode, '{m}')")} AS {n}" for n, m in STATUS_MARKS.items()]
    return ", ".join([*marks, f"{ratio(f"http_retcode = '{missing}'")} AS oth_st"])


def method_sql() -> str:
    verbs = [f"{ratio(f"contains(http_method, '{m}')")} AS \"{m}\"" for m in METHODS]
    return ", ".join([*verbs, f"{ratio("http_method = '-'")} AS OTH"])


def traffic_sql(digits: int = 4) -> str:
    out = []
    for side, name in (("forward", "req"), ("backward", "resp")):
        for unit in ("bytes", "packets"):
            c = f"{unit}_{side}"
            out.append(f"round(avg({c}), {digits}) AS {name}_{unit[0]}mean")
            out.append(f"round(var_pop({c}), {digits}) AS {name}_{unit[0]}var")
    return ", ".join(out)


def clock_sql(ts: str = "logtime") -> str:
    hours = [f"{ratio(f'hour({ts}) = {h}')} AS hour_{h}" for h in range(24)]
    days = [f"{ratio(f'isodow({ts}) = {d}')} AS day_{d}" for d in range(1, 8)]
    return ", ".join(hours + days)


def clean_sql(c: str) -> str:
    marked = rf"regexp_replace(replace({c}, '.', ' ddott '), '[%/!@#$?,;:&*)(-+=]', ' ', 'g')"
    return f"regexp_replace({marked}, '[^a-zA-Z ]', '', 'g')"


def url_chars_sql(c: str) -> str:
    return f"regexp_replace({c}, '[^a-zA-Z.:,=&?$/]', '', 'g')"


def digest_sql(c: str, name: str, distinct: bool = True) -> str:
    """How many texts there are in a column and two sums of hashes of them."""
    once = "DISTINCT " if distinct else ""
    sums = [f"coalesce(sum({once}CAST('0x' || substr(md5({c}), {start}, 15) AS BIGINT)), 0)" for start in (1, 16)]
    return f"count({once}{c}) AS {name}_texts, concat_ws(':', {', '.join(sums)}) AS {name}_digest"


def joined_sql(c: str, distinct: bool = True) -> str:
    """All texts of a column, sorted, blanks between."""
    return f"array_to_string(list_sort(list({'DISTINCT ' if distinct else ''}{c})), ' ')"


def whole_sql(columns: dict[str, str], distinct: bool = True) -> str:
    """Numbers and digests of some text columns, then all their texts."""
    digests = [digest_sql(c, name, distinct) for name, c in columns.items()]
    return ", ".join([*digests, *[f"{joined_sql(c, distinct)} AS {name}" for name, c in columns.items()]])


def texts_sql(rows: str, keys: str, columns: dict[str, str], distinct: bool = True) -> str:
    """The long table (keys, column, text, n) of some text columns."""
    n = "CAST(1 AS BIGINT)" if distinct else "count(*)"
    parts = [
        f"""SELECT {keys}, '{name}' AS "column", {c} AS text, {n} AS n FROM {rows}
            WHERE {c} IS NOT NULL GROUP BY ALL""" for name, c in columns.items()
    ]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


HAS_TEXT = "NOT (http_host = '' AND http_agent = '' AND http_query = '')"
NOT_ASSET = "NOT EXISTS (SELECT 1 FROM ip_ast a WHERE a.ip = src_ip)"
