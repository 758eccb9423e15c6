"""Row filters as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlog.constants import (
    CREDENTIAL_TERMS,
    INJECTION_TERMS,
    SCANNER_TERMS,
    SIGNATURES,
    XSS_TAG,
)
from wardlog.functions.text import any_of
from wardlog.functions.times import at, day_start


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_range(c: str | Column, start: str, end: str) -> Column:
    """Both ends included. Compares the raw column, so the scan can use it."""
    return _col(c).between(at(start), at(end))


def in_days(c: str | Column, day: str, first: int, last: int) -> Column:
    """From midnight of day+first to midnight of day+last, both included."""
    return _col(c).between(day_start(day, first), day_start(day, last))


def on_day(c: str | Column, day: str) -> Column:
    return _col(c) == F.lit(day).cast("date")


def has_text() -> Column:
    empty = (F.col("http_host") == "") & (F.col("http_agent") == "") & (F.col("http_query") == "")
    return ~empty


def is_ipv4(c: str | Column = "src_ip") -> Column:
    return _col(c).like("%.%.%.%")


def matched_signature(path: str = "http_path", query: str = "http_query") -> Column:
    """The first signature the path or query matches, NULL where none does."""
    columns = {"http_path": path, "http_query": query}
    return F.coalesce(*[F.when(F.lower(F.col(columns[c])).like(p), F.lit(p)) for c, p in SIGNATURES])


def file_probe() -> Column:
    return matched_signature().isNotNull()


def injection() -> Column:
    return any_of(F.col("http_query"), INJECTION_TERMS)


def scanner() -> Column:
    return any_of(F.col("http_agent"), SCANNER_TERMS)


def credential() -> Column:
    return any_of(F.col("http_query"), CREDENTIAL_TERMS)


def xss() -> Column:
    return F.lower(F.col("http_query")).rlike(XSS_TAG) & (F.col("http_query") != "-")


def spoofed() -> Column:
    forwarded = F.col("http_xfor")
    return (forwarded != F.col("src_ip")) & (forwarded != "-") & ~forwarded.like("%,%")


def known_noise(exclusions: Sequence[tuple[str, str]]) -> Column:
    """True for rows an exclusion names; each is a (column, LIKE pattern) pair."""
    return reduce(or_, [F.col(c).like(p) for c, p in exclusions], F.lit(False))


def has_session(c: str | Column = "http_cookie") -> Column:
    return F.contains(_col(c), F.lit("SESSION"))


def attempt_or_vulnerability(c: str | Column = "attack_name") -> Column:
    """attempt OR (Vulnerability AND NOT SQL AND NOT Scan)."""
    name = _col(c)
    weak = name.like("%Vulnerability%") & ~name.like("%SQL%") & ~name.like("%Scan%")
    return name.like("%attempt%") | weak


def reviewed(model_id: int) -> Column:
    return (F.col("model_id") == model_id) & (F.col("feedback") != -1)
