"""Streamed runs against the batch results, over several files and starts."""

import pytest
from pyspark.sql import functions as F

from wardlog.ml.rarity import merged_counts, token_counts
from wardlog.operators.profiles import distinct_ports
from wardlog.plans.extraction import http_counts, http_profile, http_profile_of, merged_http_counts
from wardlog.sources.files import Markers
from wardlog.streaming import jobs
from wardlog.streaming.state import MergedState


def in_files(df, path, n):
    for i, piece in enumerate(range(n)):
        part = df.where(F.pmod("event_id", F.lit(n)) == piece)
        part.coalesce(1).write.mode("append").parquet(path)
        yield i


def test_profile_over_restarts_equals_batch(data, spark, tmp_path):
    log = data.http_log
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    out, files = None, []
    for _ in in_files(log, source, 5):
        # The pieces overlap in time over the whole log: most rows come late.
        out = jobs.run_hourly_profile(jobs.read_files(spark, source, 1), target, every=2)
        files.append(len({f.split("/data/")[-1].split("/")[0] for f in out.inputFiles() if "/data/" in f}))
    # two batches make a base; a start reads the base and at most one batch since
    assert files == [1, 0, 1, 0, 1]
    state = jobs.profile_state(spark, target, 2)
    before = sorted(map(str, out.collect()))
    assert state.clean() == 5 and sorted(map(str, jobs.shown_profile(state.current()).collect())) == before
    batch = log.groupBy(
        F.date_trunc("hour", "end_time").cast("timestamp_ntz").alias("lgtime"), "src_ip", "dst_ip"
    ).agg(F.count(F.lit(1)).alias("cnt"), distinct_ports().alias("ports"), F.max("end_time").alias("end_time"))
    columns = ["lgtime", "src_ip", "dst_ip", "cnt", "ports", "end_time"]
    assert sorted(map(str, jobs.shown_profile(state.current()).select(*columns).collect())) == sorted(
        map(str, batch.select(*columns).collect())
    )


def test_dictionary_over_restarts_equals_batch(data, spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in in_files(data.events, source, 4):
        out = jobs.run_token_counts(
            jobs.read_files(spark, source), target, ["props"], ["value"], ["event_type"], every=3
        )
    batch = token_counts(data.events, ["props"], ["value"], ["event_type"])
    assert sorted(map(str, out.select(*batch.columns).collect())) == sorted(
        map(str, batch.collect())
    )
    assert jobs.dictionary(spark, target).last() == 3


def test_a_lost_start_replays_to_the_same_rows(spark, rows, tmp_path, monkeypatch):
    """A batch written twice, a base that was never marked and one that two starts make."""
    state = MergedState(spark, str(tmp_path), jobs.added_counts, every=2)
    assert state.current() is None and state.last() == -1 and not state.compact()
    batch = lambda *values: rows(list(values), "token string, cnt bigint")
    got = lambda: sorted(map(tuple, state.current().collect()))
    state.write(batch(("a", 1), ("b", 2)), 0)
    state.write(batch(("a", 9)), 1)
    state.write(batch(("a", 4), ("c", 5)), 1)
    want = [("a", 5), ("b", 2), ("c", 5)]
    assert got() == want
    claim = Markers.claim

    def lost(self, name, content):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(Markers, "claim", lost)
        with pytest.raises(RuntimeError):
            state.compact()
    assert got() == want and state.compact() and got() == want
    state.write(batch(("b", 1)), 2)
    state.write(batch(("b", 1)), 3)
    other = MergedState(spark, str(tmp_path), jobs.added_counts, every=2)

    def late(self, name, content):
        if self is state._bases and "3" not in other._bases.names():
            assert other.compact()
        return claim(self, name, content)

    with monkeypatch.context() as m:
        m.setattr(Markers, "claim", late)
        assert not state.compact()
    want = [("a", 5), ("b", 4), ("c", 5)]
    assert got() == want and state.clean() > 0 and got() == want and state.last() == 3


def test_merge_of_halves_is_whole(data):
    docs = data.documents
    odd = F.col("doc_id") % 2 == 1
    halves = merged_counts(token_counts(docs.where(odd), ["text"]), token_counts(docs.where(~odd), ["text"]))
    whole = token_counts(docs, ["text"])
    assert sorted(map(str, halves.collect())) == sorted(map(str, whole.collect()))


def test_a_key_is_scored_on_all_its_rows(data, spark, tmp_path):
    source, target = str(tmp_path / "in[1]"), str(tmp_path / "out")
    keys = ["src_ip", "dst_ip"]

    def count(rows):
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), F.max("end_time").alias("end_time"))

    def merge(counts):
        return counts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.max("end_time").alias("end_time"))

    sizes = []
    for _ in in_files(data.http_log, source, 5):
        out = jobs.run_scoring(jobs.read_files(spark, source, 1), target, keys, count, merge, lambda c: c, every=2)
        sizes.append(out.count())
    batch = count(data.http_log)
    assert sorted(map(str, out.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert sizes[-1] == batch.count()
    again = jobs.run_scoring(jobs.read_files(spark, source, 1), target, keys, count, merge, lambda c: c, every=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_streamed_profiles_equal_those_of_the_whole_log(data, spark, tmp_path):
    source = str(tmp_path / "in")
    state = MergedState(spark, str(tmp_path / "out"), merged_http_counts, every=2)
    for _ in in_files(data.http_log, source, 3):
        jobs.run_batches(jobs.read_files(spark, source, 1), state, http_counts)
    got, want = http_profile_of(state.current()), http_profile(data.http_log)
    for table in ("measures", "texts"):
        a, b = getattr(got, table), getattr(want, table)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
