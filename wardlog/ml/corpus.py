"""Synthetic payload texts drawn from a keyword pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.constants import SQL_KEYWORDS


def _drawn(*parts):
    """A number from a hash of the parts: the same on every run and retry."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("bigint")


def payload_texts(df: DataFrame, key: str, pool: Sequence[str] = SQL_KEYWORDS, least: int = 4):
    """One payload per row: ``least`` to pool-size - 1 keywords, drawn with
    repetition and written in pool order without blanks."""
    words = F.array(*[F.lit(w) for w in pool])
    name = F.col(key).cast("string")
    size = _drawn(name, F.lit("size")) % (len(pool) - least) + least
    places = F.transform(
        F.sequence(F.lit(1).cast("bigint"), size),
        lambda i: (_drawn(name, i.cast("string")) % len(pool)).cast("int"),
    )
    chosen = F.transform(F.sort_array(places), lambda i: F.get(words, i))
    return df.withColumn("payload", F.array_join(chosen, ""))


def keyword_subsets(
    df: DataFrame, key: str, pool: Sequence[str] = SQL_KEYWORDS, least: int = 1
) -> DataFrame:
    """One random subset of the pool per row, ``least`` to half the pool long."""
    name = F.col(key).cast("string")
    ranked = F.array(
        *[F.struct(_drawn(name, F.lit(w)).alias("r"), F.lit(w).alias("w")) for w in pool]
    )
    most = max(len(pool) // 2, least)
    size = (_drawn(name, F.lit("subset")) % (most - least + 1) + least).cast("int")
    chosen = F.slice(F.sort_array(ranked), F.lit(1), size)
    return df.withColumn("subset", F.array_join(F.transform(chosen, lambda x: x["w"]), " "))
