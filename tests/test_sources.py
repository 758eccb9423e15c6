"""Scans, versions and tables."""

import pytest
from pyspark.sql import functions as F

from wardlog.session import checkpointed, configure, shared_dir
from wardlog.sources import sinks
from wardlog.sources.tables import read_window, require_version, run_config, stored_columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_and_columns_reach_the_scan(data, spark):
    rows = read_window(spark, data.path("events"), "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    text = plan(rows.select("event_id"))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_day_filter_prunes_partitions(data, spark, tmp_path):
    rows = data.events.withColumn("logdate", F.date_format("ts", "yyyyMMdd").cast("int"))
    sinks.write_by_day(rows, str(tmp_path / "t"), order="ts")
    day = spark.read.parquet(str(tmp_path / "t")).where("logdate = 20240110")
    assert "PartitionFilters: [isnotnull(logdate" in plan(day)
    ts = [r.ts for r in day.select("ts").collect()]
    assert ts and all(t.day == 10 for t in ts)
    assert ts == sorted(ts)


def test_version_lookup(rows):
    versions = rows([("2024_01_02_03_04",), ("2024_01_05_00_00",)], "model_ver string")
    assert require_version(versions, "2024_01_04_00_00") == "2024_01_02_03_04"
    with pytest.raises(LookupError):
        require_version(versions, "2023_01_01_00_00")


def test_run_config_branches(data):
    train = run_config(data.registry, "train").where("model_id = 7").first()
    predict = run_config(data.registry, "predict", 7).first()
    assert train.data_limit == 70 and predict.data_limit == 7
    assert predict.crontab == "*/5 * * * *" and train.n_grams_upper == 2


def test_append_takes_columns_by_name(rows, spark, tmp_path):
    sinks.create_tables(spark, str(tmp_path))
    row = rows(
        [(0.5, 2.0, "d", "s", 80, 334)],
        "probs double, result double, dst_ip string, src_ip string, dst_port int, model_id int",
    )
    times = {c: F.lit("2024-03-01 10:00:00").cast("timestamp_ntz") for c in ("start_time", "end_time")}
    sinks.append_rows(row.withColumns(times), str(tmp_path), "result")
    sinks.append_rows(row.withColumns(times), str(tmp_path), "result")
    back = sinks.read_rows(spark, str(tmp_path), "result").collect()
    assert len(back) == 2 and back[0].hash == back[1].hash
    assert (back[0].src_ip, back[0].dst_ip, back[0].logdate, back[0].feedback) == ("s", "d", 20240301, "-")
    with pytest.raises(ValueError):
        sinks.append_rows(row.drop("src_ip").withColumns(times), str(tmp_path), "result")


def test_stored_columns(data):
    assert stored_columns(data.region, ["r_name"]) == ["r_regionkey"]


def test_session_settings(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert shared_dir(spark) == shared_dir(spark)
    assert checkpointed(spark.range(3)).count() == 3
