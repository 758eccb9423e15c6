"""Steps that every word of a log or a document table goes through: same results, fewer of them."""

import re

import pytest
from pyspark.sql import functions as F

from wardlog.functions.text import letters_only, payload_words
from wardlog.ml.rarity import grouped_text_rarity, text_rarity, token_counts
from wardlog.ml.textvec import vocabulary
from wardlog.plans.extraction import http_counts

ODD = ["", " ", None, "aZ z9", "a.b/c?d=e&f", "ä€𝄞x́y", "\x00a\x00b\n\t", "99", "a-b_c[d]^e\\f$g", "𝄞𝄞", "İıſK"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_letters_are_left(rows):
    df = rows([(i, t) for i, t in enumerate(ODD)], "id int, t string")
    got = {r.id: r.x for r in df.select("id", letters_only(F.col("t")).alias("x")).collect()}
    assert got == {i: None if t is None else re.sub("[^a-zA-Z ]", "", t) for i, t in enumerate(ODD)}


def test_letters_are_not_searched_by_pattern(rows):
    df = rows([("a",)], "t string").select(payload_words(F.col("t")).alias("x"))
    assert "regexp_replace" not in plan_of(df)


def test_profile_counts_clean_without_patterns(spark, data):
    assert "regexp_replace" not in plan_of(http_counts(data.http_log.limit(10))).split("Generate")[0]


def test_vocabulary_sorts_and_compares_without_lambdas(rows):
    df = rows([("bbs Bee bee ant",), ("ant x yy",), ("ant x yy",), ("",), (None,)], "t string")
    out = vocabulary(df, "t", 10)
    assert {r.term: (r.cnt, r.docs) for r in out.collect()} == {"bee": (2, 1), "ant": (2, 2), "yy": (1, 1)}
    assert "lambda" not in plan_of(out)
    pairs = vocabulary(df, "t", 10, 1, 2)
    assert {r.term: (r.cnt, r.docs) for r in pairs.collect()}["ant yy"] == (1, 1)


GROUPED = [
    (1, "a", "x x y"), (2, "a", "x z"), (3, "b", "y"), (4, "c", "x y"), (5, "c", "w"), (6, None, "x"), (7, "a", ""),
    (8, "b", None), (9, "c", "x  x x"), (10, "a", "w"), (None, "b", "y y"), (None, "b", "y"), (3, "b", "y"),
]


def by_hand(table, groups):
    """Scores counted out; ``groups`` of the dictionary are those other than c."""
    known = [(g, w) for _, g, t in table if g != "c" and t for w in t.split()]
    out = {}
    for key in {k for k, _, _ in table}:
        mine = [(g, w) for k, g, t in table if k == key for w in (t or "").split()]
        counts, total = [], 0
        for g, w in mine:
            if not groups or g == "c":
                own = known
            else:
                own = [] if g is None else [e for e in known if e[0] == g]
            counts.append(sum(1 for e in own if e[1] == w))
            total = max(total, len(own))
        out[key] = 1 - (sum(counts) / len(mine) / total) ** 0.5 if mine and all(counts) else 0.0
    return out


def test_rarity_of_known_missing_and_null_groups(rows):
    df = rows(GROUPED, "id int, g string, t string")
    known = df.where("g is null or g <> 'c'")
    got = {r.id: r.score for r in grouped_text_rarity(df, "id", "t", "g", token_counts(known, ["t"], groups=["g"])).collect()}
    assert got == pytest.approx(by_hand(GROUPED, True))
    got = {r.id: r.score for r in text_rarity(df, "id", "t", token_counts(known, ["t"])).collect()}
    assert got == pytest.approx(by_hand(GROUPED, False))


def test_grouped_rarity_makes_no_list_of_pairs(rows):
    """The words of the rows are joined to the dictionary as they are, not listed and looked up first."""
    df = rows(GROUPED, "id int, g string, t string")
    counts = rows([("a", "t", "x", 2)], "g string, column string, token string, cnt bigint")
    plan = plan_of(grouped_text_rarity(df, "id", "t", "g", counts))
    assert "Aggregate [g#" not in plan
    assert plan.count("split(") == 3  # a part of the rows each
