"""Hand-computed cases for the easily missed rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wardlog.functions import text, times, vectors
from wardlog.ml.rarity import text_rarity, token_counts, value_rarity
from wardlog.ml.scaling import box_threshold, fit_scaler, mad_threshold, min_max
from wardlog.ml.slots import sparse
from wardlog.ml.textvec import fit_text, term_weights, vocabulary
from wardlog.operators import predicates as P
from wardlog.operators.joins import any_match, drop_listed, in_either, keep_listed
from wardlog.operators.ordering import gap_statistics, gaps, with_split
from wardlog.operators.profiles import port_digits, status_ratios, value_spread


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    "code, hits",
    [
        ("410", {"info_st"}),
        ("520", {"succ_st"}),
        ("204", {"succ_st"}),
        ("404", {"cler_st"}),
        ("", {"oth_st"}),
    ],
)
def test_status_marks_are_found_anywhere(rows, code, hits):
    got = one(rows([(code,)], "http_retcode string").agg(
        *[c.alias(n) for n, c in status_ratios().items()]
    ))
    assert {n for n, v in got.items() if v} == hits


def test_payload_words(rows):
    out = rows([("a.b-c_d/e(f)g+h=9 Z",)], "s string").select(text.payload_words(F.col("s")))
    assert out.first()[0] == "a ddott bcd e f g h  Z"


def test_path_keywords(rows):
    out = rows([("a.b-c_d/e(f)g+h=9 Z",)], "s string").select(text.path_keywords(F.col("s")))
    assert out.first()[0] == "a b-c d e(f)g+h   z"


@pytest.mark.parametrize(
    "query, hit",
    [
        ("q=<script>", True),
        ("q=<script src=x>", False),
        ("<a{b}>", False),
        ("<<b/>", True),
        ("-", False),
    ],
)
def test_xss_tag(rows, query, hit):
    assert rows([(query,)], "http_query string").select(P.xss()).first()[0] is hit


@pytest.mark.parametrize(
    "query, hit",
    [("1 union all select 2", True), ("pg_toast", True), ("a=1", False), ("x order by 1", True)],
)
def test_injection(rows, query, hit):
    assert rows([(query,)], "http_query string").select(P.injection()).first()[0] is hit


@pytest.mark.parametrize(
    "name, kept",
    [
        ("SQL attempt", True),
        ("SQL Vulnerability", False),
        ("Scan Vulnerability", False),
        ("Vulnerability", True),
        ("other", False),
    ],
)
def test_alert_name_precedence(rows, name, kept):
    found = rows([(name,)], "attack_name string").where(P.attempt_or_vulnerability())
    assert bool(found.count()) is kept


def test_anti_join_survives_null(rows):
    log = rows([("a",), ("b",)], "src_ip string")
    listed = rows([("a",), (None,)], "ip string")
    assert [r[0] for r in drop_listed(log, listed, "src_ip", "ip").collect()] == ["b"]
    assert [r[0] for r in keep_listed(log, listed, "src_ip", "ip").collect()] == ["a"]


def test_any_match_keeps_one(rows):
    left = rows([("a",), ("b",)], "k string")
    right = rows([("a", 2), ("a", 1)], "k string, v int")
    out = any_match(left, right, "k", {"v": 0}).orderBy("k").collect()
    assert [tuple(r) for r in out] == [("a", 1), ("b", 0)]


def test_either_source_is_union_distinct(rows):
    a, b = rows([("x",), ("y",)], "k string"), rows([("y",), ("z",)], "k string")
    assert sorted(r[0] for r in in_either(a, b, "k").collect()) == ["x", "y", "z"]


def at(seconds):
    return dt.datetime(2024, 1, 1, 23, 59, 58) + dt.timedelta(seconds=seconds)


def test_gap_statistics(rows):
    log = rows(
        [("one", at(0), 1), ("two", at(0), 2), ("two", at(1), 3), ("two", at(4), 4)],
        "c string, t timestamp_ntz, id int",
    )
    got = {r.c: (r.events, r.diff_avg, r.diff_std) for r in gap_statistics(log, "c", "t").collect()}
    assert got == {"one": (1, 0.0, 0.0), "two": (3, 2.0, 1.0)}


def test_gaps_cross_midnight(rows):
    log = rows(
        [("c", at(s), i) for i, s in enumerate([0, 0, 1, 5, 200_000])],
        "c string, t timestamp_ntz, id int",
    )
    got = {r.id: r.gap for r in gaps(log, "c", "t", "id").collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 4, 4: 199_995}


def test_words_and_n_grams(rows):
    df = rows([("A bc ddott É éa x1 y page",)], "s string")
    w = text.words(F.col("s"))
    assert df.select(w).first()[0] == ["bc", "ddott", "éa", "x1"]
    assert df.select(text.n_grams(w, 2, 3)).first()[0] == [
        "bc ddott", "ddott éa", "éa x1", "bc ddott éa", "ddott éa x1",
    ]
    short = rows([("bc",)], "s string").select(text.n_grams(text.words(F.col("s")), 2, 2))
    assert short.first()[0] == []


DOCS = [(1, "aa bb"), (2, "aa cc cc"), (3, "aa")]


def test_term_weights(rows):
    df = rows(DOCS, "id int, text string")
    vocab = vocabulary(df, "text", 3)
    got = {(r.id, r.term): r.weight for r in term_weights(df, "id", "text", vocab).collect()}
    assert got[(2, "aa")] == pytest.approx(0.283217, abs=1e-6)
    assert got[(2, "cc")] == pytest.approx(0.959056, abs=1e-6)
    model = fit_text(df, "text", 3)
    assert model.names == ["text_aa", "text_bb", "text_cc"]
    vec = {r.id: r.text_vec.toArray() for r in model.transform(df).collect()}
    assert vec[2] == pytest.approx([0.283217, 0, 0.959056], abs=1e-6)


def test_vocabulary_counts_different_texts(rows):
    df = rows([("aa",), ("aa",), ("bb bb",)], "text string")
    got = {r.term: (r.cnt, r.docs) for r in vocabulary(df, "text", 5).collect()}
    assert got == {"aa": (1, 1), "bb": (2, 1)}


def test_constant_column_scales_to_zero(rows):
    df = rows([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in min_max(df, ["a", "b"]).orderBy("a").collect()] == [(0, 0), (1, 0)]
    vec = df.select(F.array("a", "b").alias("values")).withColumns(sparse(F.col("values")))
    out = fit_scaler(vec, 2).transform(vec).select("places", "weights").collect()
    assert sorted((tuple(r.places), tuple(r.weights)) for r in out) == [((), ()), ((0,), (1.0,))]


def test_box_and_mad_threshold(rows):
    df = rows([(float(x),) for x in (1, 2, 3, 10)], "v double")
    assert box_threshold(df, "v") == 82.75
    # median 2.5, distances 1.5 .5 .5 7.5, their median 1
    assert mad_threshold(df, "v", 1.0, 7.0).first()[0] == 10.0


def test_rarity(rows):
    df = rows([(1, "x y"), (2, "x x"), (3, ""), (4, "x q")], "id int, t string")
    known = token_counts(df.where("id < 3"), ["t"])
    got = {r.id: r.score for r in text_rarity(df, "id", "t", known).collect()}
    assert got[1] == pytest.approx(1 - math.sqrt((3 + 1) / 2 / 4))
    assert got[2] == pytest.approx(1 - math.sqrt(3 / 4))
    assert got[3] == 0 and got[4] == 0


def test_value_rarity(rows):
    df = rows([(1, 5), (2, 5), (3, 6), (4, 9)], "id int, v int")
    known = token_counts(df.where("id < 4"), numbers=["v"])
    got = {r.id: r.score for r in value_rarity(df, "id", "v", known).collect()}
    assert got[3] == pytest.approx(1 - math.sqrt(1 / 3)) and got[4] == 0


def test_entropy(rows):
    df = rows([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "k string, v string")
    out = {r.k: (r.v_ent, r.v_kinds) for r in value_spread(df, ["k"], {"v": F.col("v")}).collect()}
    assert out == {"a": (1.0, 2), "b": (0.0, 1)}


def test_port_digits(rows):
    df = rows([(7,), (80,), (443,), (50000,)], "dst_port long")
    got = one(df.agg(*[c.alias(n) for n, c in port_digits().items()]))
    assert [got[f"port_{i}"] for i in range(1, 6)] == [0.25, 0.25, 0.25, 0, 0.25]


def test_durations(rows):
    cases = {"hours=3": 10800, "weeks=8": 4838400, "years=1": 86400, "x": 86400, "days=a": 86400}
    df = rows([(c,) for c in cases], "s string")
    got = {r[0]: r[1] for r in df.select("s", times.duration_seconds(F.col("s"))).collect()}
    assert got == cases


def test_cron_units(rows):
    cases = {
        "*/1 * * * *": "minute", "* * * * *": "minute", "*/5 * * * *": "5minute",
        "*/15 * * * *": "15minute", "0 */1 * * *": "hour", "0 0 */1 * *": "day",
        "0 0 */4 * *": "quarter", "0 0 1 */1 *": "month", "0 0 1 1 */1": "year",
        "5 4 * * *": "hour", "bad": "hour",
    }
    df = rows([(c,) for c in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", times.cron_unit(F.col("s"))).collect()} == cases


def test_labels(rows):
    df = rows([("(12)XSS",), ("XSS",), ("a)b)c",)], "y string")
    assert [r[0] for r in df.select(text.after_bracket(F.col("y"))).collect()] == ["XSS", "XSS", "b)c"]
    code = vectors.result_code(F.lit("FILE_DOWNLOAD"), 334)
    assert df.select(code).first()[0] == 33404
    assert df.select(vectors.class_c(F.lit("10.1.2.3"))).first()[0] == "10.1.2.xxx"


def test_split_parts_the_rows(rows):
    df = with_split(rows([(i,) for i in range(2000)], "id long"), ["id"])
    n = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert n["train"] + n["test"] == 2000 and 1300 < n["train"] < 1500


def test_quantiles_end_on_infinity_and_nan(spark, monkeypatch):
    from wardlog.operators import quantiles as q

    monkeypatch.setattr(q, "SMALL", 50)
    inf, nan = float("inf"), float("nan")
    finite = [float(i * i % 1013) for i in range(400)] + [-1.7e308, 1.7e308]
    values = [-inf, *sorted(finite), inf, inf, nan]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    n = len(values)
    places = [0, 1, 150, n - 4, n - 3]
    assert q.quantiles(df, "x", [p / (n - 1) for p in places]) == [values[p] for p in places]
    assert str(q.quantiles(df, "x", [1.0])[0]) == "nan"
    assert q.quantiles(df.where("x = cast('Infinity' as double)"), "x", [0.5]) == [inf]
