"""Runs that fill result tables, and the jobs made of them."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wardlog.plans.jobs import newest_version, predict, train
from wardlog.sources.files import Markers
from wardlog.sources.runs import SCHEMAS, RunTables, schema_of


def metrics(spark, n, day="2024-01-01"):
    return spark.range(n).selectExpr(
        "cast(1 as bigint) AS model_id", "'XSS' AS attack_name", "id AS epochs", "rand() AS loss", "0.5 AS accuracy",
        f"timestamp_ntz'{day} 10:00:00' AS logtime", "'more' AS extra",
    )


def test_a_repeated_run_is_there_once(spark, tmp_path):
    tables = RunTables(spark, str(tmp_path))
    assert tables.read("metrics").count() == 0 and tables.runs() == {}
    assert tables.commit("a", {"metrics": metrics(spark, 5)}, {"x": 1})
    assert not tables.commit("a", {"metrics": metrics(spark, 9)})
    assert tables.commit("b", {"metrics": metrics(spark, 3, "2024-01-02")})
    back = tables.read("metrics")
    assert back.count() == 8 and sorted({r.logdate for r in back.collect()}) == [20240101, 20240102]
    assert tables.read("metrics", "b").count() == 3 and tables.runs("a")["a"]["notes"] == {"x": 1}
    assert [f.name for f in back.schema][:-1] == [f.name for f in schema_of("metrics")]
    with pytest.raises(ValueError):
        tables.commit("../a", {})


def test_two_writers_of_one_run(spark, tmp_path, monkeypatch):
    """Both looked before either had finished: one of them is in, the other leaves nothing."""
    first, second = RunTables(spark, str(tmp_path)), RunTables(spark, str(tmp_path))
    claim = Markers.claim

    def late(self, name, content):
        if self is second._markers and not first.runs():
            assert first.commit("a", {"metrics": metrics(spark, 5)})
        return claim(self, name, content)

    monkeypatch.setattr(Markers, "claim", late)
    assert not second.commit("a", {"metrics": metrics(spark, 9)})
    assert first.read("metrics").count() == 5 and second.sweep() == 0
    assert len(os.listdir(tmp_path / "metrics" / "a")) == 1


def test_a_lost_attempt_is_not_read(spark, tmp_path, monkeypatch):
    tables = RunTables(spark, str(tmp_path))

    def lost(self, name, content):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(Markers, "claim", lost)
        with pytest.raises(RuntimeError):
            tables.commit("a", {"metrics": metrics(spark, 9)})
    assert tables.read("metrics").count() == 0 and tables.commit("a", {"metrics": metrics(spark, 4)})
    assert tables.read("metrics").count() == 4 and tables.sweep() == 1 and tables.read("metrics").count() == 4


def test_days_are_pruned(spark, tmp_path):
    tables = RunTables(spark, str(tmp_path))
    for i, day in enumerate(("2024-01-01", "2024-01-02")):
        tables.commit(f"r{i}", {"metrics": metrics(spark, 5, day)})
    assert tables.read("metrics").where("logdate = 20240102").count() == 5


def test_jobs(data, spark, tmp_path):
    now = data.events.agg(F.max("ts")).first()[0]
    model = data.customer.where("c_custkey % 48 >= 40 AND c_nationkey >= 5").agg(F.max("c_custkey")).first()[0]
    args = (spark, data.registry, model, now, data.http_log)
    with pytest.raises(LookupError):
        predict(*args, str(tmp_path))
    version = train(*args, data.ip_ast, str(tmp_path), depth=3)
    tables = RunTables(spark, f"{tmp_path}/tables")
    assert newest_version(tables, model, now) == version
    with pytest.raises(LookupError):
        newest_version(tables, model, now - dt.timedelta(days=1))
    run = predict(*args, str(tmp_path))
    counts = {t: tables.read(t).count() for t in SCHEMAS}
    assert counts["result"] == counts["result_text"] > 0 and counts["tree_nodes"] >= 1
    assert counts["importance"] >= 7 and counts["history"] <= counts["metrics"] + 1
    named = tables.read("result").where("att_name <> 'NORMAL'").count()
    assert counts["evidence"] >= named > 0 or named == 0 == counts["evidence"]
    assert train(*args, data.ip_ast, str(tmp_path)) == version and predict(*args, str(tmp_path)) == run
    assert counts == {t: tables.read(t).count() for t in SCHEMAS}
    with pytest.raises(LookupError):
        train(spark, data.registry, -1, now, data.http_log, data.ip_ast, str(tmp_path))
