"""Frequency dictionaries and rarity scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.operators.ordering import union_all
from wardlog.session import stored

# Fixed value: the characters that separate words.
BLANKS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def pieces(c: str) -> Column:
    """The text cut at blanks; a blank at either end leaves an empty piece."""
    return F.split(c, BLANKS)


def token_counts(
    df: DataFrame,
    texts: Sequence[str] = (),
    numbers: Sequence[str] = (),
    groups: Sequence[str] = (),
) -> DataFrame:
    """Counts per (group, column, token): words of texts, whole values of numbers."""
    parts = [(c, pieces(c)) for c in texts] + [(c, F.array(F.col(c).cast("string"))) for c in numbers]
    lists = F.array(*[F.struct(F.lit(c).alias("column"), p.alias("tokens")) for c, p in parts])
    rows = df.select(*groups, F.explode(lists).alias("p"))
    rows = rows.select(*groups, F.col("p.column").alias("column"), F.explode("p.tokens").alias("token"))
    rows = rows.where(F.col("token").isNull() | (F.col("token") != ""))
    return rows.groupBy(*groups, "column", "token").agg(F.count(F.lit(1)).alias("cnt"))


def merged_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = [c for c in old.columns if c != "cnt"]
    return old.unionByName(new).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def _text_tokens(df: DataFrame, key: str, text: str, groups: Sequence[str]) -> DataFrame:
    """A row a word; a text without words has one row with a null token."""
    token = F.explode_outer(pieces(text)).alias("token")
    return df.select(key, *groups, token).withColumn("token", F.nullif("token", F.lit("")))


def _fold(met: DataFrame, key: str, total) -> DataFrame:
    """Score per key from its words' counts; 0 where a word is unknown or there is none."""
    words = F.count("token")
    known = (words > 0) & (F.count("cnt") == words)
    score = F.when(known, 1 - F.sqrt(F.sum("cnt") / words / total))
    return met.groupBy(key).agg(F.coalesce(score, F.lit(0.0)).alias("score"))


def text_rarity(df: DataFrame, key: str, text: str, counts: DataFrame) -> DataFrame:
    """1 - sqrt(mean token count / all tokens); 0 for unknown tokens and empty texts."""
    mine = counts.where(F.col("column") == text).select("token", "cnt")
    total = mine.agg(F.sum("cnt")).scalar()
    met = _text_tokens(df, key, text, ()).join(mine, "token", "left")
    return _fold(met, key, total)


def value_rarity(df: DataFrame, key: str, column: str, counts: DataFrame) -> DataFrame:
    """1 - sqrt(share of the value); 0 for unknown values."""
    mine = counts.where(F.col("column") == column).select("token", "cnt")
    total = mine.agg(F.sum("cnt")).scalar()
    rows = df.select(key, F.col(column).cast("string").alias("token"))
    score = 1 - F.sqrt(F.col("cnt") / total)
    return rows.join(mine, "token", "left").select(
        key, F.coalesce(score, F.lit(0.0)).alias("score")
    )


def _resolved(pairs: DataFrame, counts: DataFrame, column: str, group: str) -> DataFrame:
    """(group, token) pairs with the token's count and the total of the group's dictionary.

    A group that has no dictionary takes the common one, the sum of all groups'.
    Only the different pairs come here, so a group or token that many rows share
    is looked up once.
    """
    own = counts.where(F.col("column") == column).select(group, "token", "cnt")
    known = own.groupBy(group).agg(F.sum("cnt").alias("total"))
    common = own.groupBy("token").agg(F.sum("cnt").alias("common"))
    everyone = own.agg(F.sum("cnt")).scalar()
    met = (
        pairs.join(own, [group, "token"], "left")
        .join(known, group, "left")
        .join(common, "token", "left")
    )
    missing = F.col("total").isNull()
    return met.select(
        group,
        "token",
        F.when(missing, F.col("common")).otherwise(F.col("cnt")).alias("cnt"),
        F.coalesce("total", everyone).cast("double").alias("total"),
    )


def grouped_value_share(
    df: DataFrame, key: str, column: str, group: str, counts: DataFrame
) -> DataFrame:
    """Share of the value in its group's dictionary, or in the common one."""
    rows = df.select(key, group, F.col(column).cast("string").alias("token"))
    found = _resolved(rows.select(group, "token").distinct(), counts, column, group)
    score = F.coalesce(F.col("cnt") / F.col("total"), F.lit(0.0))
    return rows.join(found, [group, "token"], "left").select(key, score.alias("score"))


def grouped_text_rarity(
    df: DataFrame, key: str, text: str, group: str, counts: DataFrame
) -> DataFrame:
    """Text rarity within the group's dictionary, or the common one.

    Rows are parted by whether their group has a dictionary, so a text is split once and
    its words meet one dictionary only. That is written once, as it is read several
    times, and so is the list of its groups, whose size Spark then knows.
    """
    own = stored(counts.where(F.col("column") == text).select(group, "token", "cnt"), "dictionary")
    known = stored(own.groupBy(group).agg(F.sum("cnt").cast("double").alias("total")), "groups")
    common = own.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    everyone = own.agg(F.sum("cnt").cast("double")).scalar()
    # a row without a group finds no word
    columns = [key, "token", "cnt", "total"]
    met = [
        _text_tokens(df.join(known, group), key, text, [group, "total"]).join(own, ["token", group], "left"),
        _text_tokens(df.where(F.col(group).isNotNull()).join(known, group, "left_anti"), key, text, ())
        .join(common, "token", "left").withColumn("total", everyone),
        _text_tokens(df.where(F.col(group).isNull()), key, text, ())
        .withColumns({"cnt": F.lit(None).cast("bigint"), "total": F.lit(None).cast("double")}),
    ]
    return _fold(union_all([m.select(*columns) for m in met]), key, F.max("total"))
