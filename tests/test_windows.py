"""Windows over nested grains, and windows over logs stored by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardlog.operators import windows as W
from wardlog.operators.joins import members_of_stored_days
from wardlog.sources.sinks import write_by_day

START = dt.datetime(2024, 1, 1)
LOG = "src_ip string, logtime timestamp_ntz, end_time timestamp_ntz, x int"
SPANS = "src_ip string, start_time timestamp_ntz, end_time timestamp_ntz"


def made(n, spans, seed, days=9):
    rng = random.Random(seed)

    def when():
        return START + dt.timedelta(minutes=rng.randrange(days * 24 * 60))

    log = []
    for i in range(n):
        t = when()
        log.append((rng.choice("ab"), t, t + dt.timedelta(minutes=rng.choice([0, 1, 50, 200])), i % 7))
    found = [(rng.choice("abc"), *sorted((when(), when()))) for _ in range(spans)]
    found += found[:4] + [("a", START + dt.timedelta(days=5), START)]
    found += [("a", START + dt.timedelta(days=1), START + dt.timedelta(days=4)), ("b", START, START + dt.timedelta(hours=3))]
    return log, found


def fold(rows, keys):
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))


def merge(parts, keys):
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))


def inside(log, spans):
    return {(k, s, e): [r for r in log if r[0] == k and r[1] >= s and r[2] <= e] for k, s, e in set(spans)}


def test_windows_equal_those_of_all_rows(rows):
    log, spans = made(900, 40, 1)
    out = W.by_window(rows(log, LOG), rows(spans, SPANS), fold, merge).collect()
    want = {w: (len(r), sum(x[3] for x in r)) for w, r in inside(log, spans).items() if r}
    assert {(r.src_ip, r.window_start, r.window_end): (r.n, r.x) for r in out} == want and len(out) == len(want) > 20


def test_hours_of_windows_equal_those_of_all_rows(rows):
    log, spans = made(900, 40, 2)
    out = W.by_window_hour(rows(log, LOG), rows(spans, SPANS), fold).collect()
    want = {}
    for w, found in inside(log, spans).items():
        for r in found:
            key = (*w, r[1].replace(minute=0))
            n, x = want.get(key, (0, 0))
            want[key] = n + 1, x + r[3]
    assert {(r.src_ip, r.window_start, r.window_end, r.lgtime): (r.n, r.x) for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("n", [600, 6000])
def test_rows_are_compared_in_edge_hours_only(rows, monkeypatch, n):
    """40 overlapping windows of days: 10 times the rows give about 10 times the comparisons, few a window."""
    log, spans = made(n, 40, 3)
    counts = []
    edge_rows = W.edge_rows

    def counted(rows, edges, key, log_start, log_end):
        counts.append(rows.join(edges, [key, "_hour"]).count())
        return edge_rows(rows, edges, key, log_start, log_end)

    monkeypatch.setattr(W, "edge_rows", counted)
    assert W.by_window(rows(log, LOG), rows(spans, SPANS), fold, merge).count() > 20
    every = sum(len(r) for r in inside(log, spans).values())
    # two cut hours a window and those whose rows last into others, of about 100 hours a window
    assert counts[0] < 0.1 * every


def test_no_windows_and_no_rows(rows):
    log, spans = made(50, 5, 4)
    assert W.by_window(rows(log, LOG), rows([], SPANS), fold, merge).count() == 0
    assert W.by_window_hour(rows([], LOG), rows(spans, SPANS), fold).count() == 0


def test_folders_are_pruned_by_the_days_of_the_windows(spark, rows, tmp_path):
    log, _ = made(2000, 1, 5)
    df = rows(log, LOG).withColumn("logdate", F.date_format("logtime", "yyyyMMdd").cast("int"))
    write_by_day(df, str(tmp_path / "log"))
    rows([("a", START + dt.timedelta(days=3, hours=2), START + dt.timedelta(days=3, hours=20), 1)], SPANS + ", kind int").write.parquet(
        str(tmp_path / "windows")
    )
    windows = spark.read.parquet(str(tmp_path / "windows")).where("kind = 1")
    out = members_of_stored_days(spark.read.parquet(str(tmp_path / "log")), windows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    span = ("a", START + dt.timedelta(days=3, hours=2), START + dt.timedelta(days=3, hours=20))
    assert out.count() == len(inside(log, [span])[span]) > 0
