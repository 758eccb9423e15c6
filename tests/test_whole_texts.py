"""Profile queries give whole texts, not only their number and digest."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from wardlog.operators.profiles import Texts, profile

DATA = "/root/testdata/sf0.001"
CELLS = {
    "a01_http_profile": ("agent_", "query_"),
    "a02_hourly_attack_profile": ("path_keywords", "query_keywords", "agent_keywords"),
    "a12_cleaned_texts": ("agent_", "query_"),
    "a13_all_texts": ("http_host", "http_path", "http_query"),
    "a29_dns_profile": ("dns_query", "dns_answer"),
    "a33_hijack_candidates": ("http_query",),
    "d01_attack_training_rows": ("agent_", "query_"),
    "d02_normal_training_rows": ("agent_", "query_"),
    "d03_prediction_rows": ("agent_", "query_"),
    "d01_d02_training_set": ("agent_", "query_"),
    **{
        n: ("path_keywords", "query_keywords", "agent_keywords")
        for n in (
            "d04_beaconing", "d05_injection", "d06_spoofing", "d07_scanning", "d08_credential", "d09_xss",
            "d04_d09_all_signatures",
        )
    },
    "d10_alert_detectors": ("http_host", "http_path", "http_query"),
    "d10_alert_detectors_low": ("http_host", "http_path", "http_query"),
    "d11_session_hijack": ("http_path", "http_query", "http_cookie"),
    "d13_http_feedback": ("http_host", "http_path", "http_query"),
    "d13_dns_feedback": ("dns_query", "dns_answer"),
}


@pytest.mark.parametrize("name", CELLS)
def test_texts_are_columns(spark, data, name):
    columns = queries()[name](spark, DATA).columns
    assert set(CELLS[name]) <= set(columns)
    assert len(set(columns)) == len(columns)


@pytest.mark.parametrize("distinct", [True, False])
def test_all_texts_in_one_cell(rows, distinct):
    texts = ["b", "a", "b", "", None, "a b", "ä", "b"]
    values = [(k, t) for k in (1, None) for t in texts] + [(2, None), (3, "x")]
    out = profile(rows(values, "k int, t string"), ["k"], {"ts": Texts(F.col("t"), distinct)})
    found = [t for t in texts if t is not None]
    want = " ".join(sorted(set(found) if distinct else found))
    got = {r.k: (r.ts, r.ts_texts) for r in out.rows.collect()}
    n = 5 if distinct else 7
    assert got == {1: (want, n), None: (want, n), 2: ("", 0), 3: ("x", 1)}
    assert "ts" not in out.measures.columns


def test_cells_nobody_reads_are_not_built(rows):
    out = profile(rows([(1, "a")], "k int, t string"), ["k"], {"ts": Texts(F.col("t"))})
    plan = out.measures._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_labelled_scan_is_not_capped(spark, data):
    assert "QUALIFY" not in oracle_sql()["s04_labelled_scan"].upper()
    counts = queries()["s04_labelled_scan"](spark, DATA).groupBy("label").count().collect()
    assert max(r["count"] for r in counts) > 40
