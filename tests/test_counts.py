"""The log is read once by a fit, and texts are cleaned after they are counted."""

from pyspark.sql import functions as F

from wardlog.functions.text import url_chars
from wardlog.operators.profiles import counted
from wardlog.plans.extraction import KEYS, http_counts, prediction_rows, training_rows


def test_values_that_are_equal_once_clean_add_up(rows):
    texts = ["a1", "a2", "a", None, "", "7", "b"]
    df = rows([(k, t, i) for k in (1, None) for i, t in enumerate(texts)], "k int, t string, i int")
    out = counted(df, ["k"], {"t": F.col("t"), "raw": F.col("t")}, {"top": F.max("i")}, {"t": url_chars})
    got = {(r.k, r["column"], r.value): (r.n, r.top) for r in out.collect()}
    for k in (1, None):
        assert {v: n for (key, c, v), n in got.items() if (key, c) == (k, "t")} == {
            "a": (3, None), None: (1, None), "": (2, None), "b": (1, None)
        }
        assert {v for (key, c, v) in got if (key, c) == (k, "raw")} == set(texts)
        assert got[k, None, None] == (len(texts), len(texts) - 1)


def test_cleaning_follows_the_count(data):
    plan = http_counts(data.http_log)._jdf.queryExecution().optimizedPlan().toString()
    first = plan.rindex("Aggregate [")
    assert "ddott" in plan[:first] and "ddott" not in plan[first:]


def test_counts_are_written_once(data):
    """Measures and texts of stored counts do not go back to the log."""
    start, end = "2024-01-02 00:00:00", "2024-01-25 00:00:00"
    stored = [prediction_rows(data.http_log, start, end, once=True), training_rows(data.http_log, data.ip_ast, start, end, once=True)]
    plain = [prediction_rows(data.http_log, start, end), training_rows(data.http_log, data.ip_ast, start, end)]
    for a, b in zip(stored, plain, strict=True):
        for name in ("rows", "texts"):
            left, right = getattr(a, name), getattr(b, name)
            assert "events.parquet" not in left._jdf.queryExecution().executedPlan().toString()
            assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
    assert set(KEYS) <= set(stored[0].keys)
