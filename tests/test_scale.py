"""The skew-safe forms against brute force, with limits small enough to bite."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlog.ml.likeness import search
from wardlog.ml.slots import fit_slots, sparse, vocabularies
from wardlog.ml.textvec import term_weights, vocabulary
from wardlog.operators import quantiles
from wardlog.operators.joins import members_of_windows
from wardlog.operators.ordering import cap_per_class, first_rows, gap_statistics, gaps, nth_keys
from wardlog.operators.profiles import Texts, profile
from wardlog.plans import feedback
from wardlog.plans.detectors import attack_profile, by_hour
from wardlog.plans.extraction import KEYS, attack_rows, normal_rows


def hot_rows(rows):
    random.seed(3)
    values = [("hot", f"text {random.randrange(60)}", i) for i in range(900)]
    values += [("hot", "same", i) for i in range(500)]
    values += [(f"k{i % 40}", f"text {i % 7}", i) for i in range(200)]
    return values, rows(values, "k string, t string, i int")


@pytest.mark.parametrize("distinct", [True, False])
def test_one_measures_row_and_all_texts_for_a_key_of_any_size(rows, distinct):
    values, df = hot_rows(rows)
    out = profile(df, ["k"], {"ts": Texts(F.col("t"), distinct)}, whole={"cnt": F.count(F.lit(1))})
    measures = {r.k: r for r in out.measures.collect()}
    assert len(measures) == out.measures.count() == len({k for k, _, _ in values})
    got = {}
    for r in out.texts.collect():
        assert r.column == "ts" and (r.k, r.text) not in got
        got[r.k, r.text] = r.n
    want = Counter((k, t) for k, t, _ in values)
    assert got == ({k: 1 for k in want} if distinct else want)
    for k, r in measures.items():
        assert r.cnt == sum(n for (key, _), n in want.items() if key == k)
        assert r.ts_texts == sum(n for (key, _), n in got.items() if key == k)


def test_digests_tell_equal_text_sets(rows):
    texts = {"a": ["x", "y", "x"], "b": ["y", "x"], "c": ["x"], "d": [], "e": ["xy"], "f": [None]}
    df = rows([(k, t) for k, ts in texts.items() for t in ts or [None]], "k string, t string")
    sets = {r.k: r.ts_digest for r in profile(df, ["k"], {"ts": Texts(F.col("t"))}).measures.collect()}
    lists = {r.k: r.ts_digest for r in profile(df, ["k"], {"ts": Texts(F.col("t"), False)}).measures.collect()}
    assert sets["a"] == sets["b"] and lists["a"] != lists["b"] and sets["d"] == sets["f"]
    assert len({sets[k] for k in "acde"}) == 4


def test_log_is_read_once(data):
    """Measures and digests of a profile come from one scan of the events."""
    plan = attack_profile(by_hour(data.http_log)).measures._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("value#") and plan.count("Aggregate [lgtime") <= 2
    scans = [line for line in plan.splitlines() if "Relation" in line and "event_id" in line]
    assert len(scans) == 1


def test_a_huge_key_has_the_same_model(rows):
    """Terms of a key with very many texts count as they do where its texts are in one row."""
    values, df = hot_rows(rows)
    out = profile(df, ["k"], {"ts": Texts(F.col("t"))}, whole={"cnt": F.count(F.lit(1))}).stored()
    slots = fit_slots(out, ["cnt"], {"ts": 30})
    joined = {}
    for k, t, _ in values:
        joined.setdefault(k, set()).add(t)
    one = rows([(k, " ".join(sorted(ts))) for k, ts in joined.items()], "k string, t string")
    terms = {r.term: (r.cnt, r.docs) for r in vocabulary(one, "t", 30).collect()}
    found = {r.term: (r.cnt, r.docs) for r in vocabularies(out, {"ts": 30}).collect()}
    assert found == terms and slots.terms["ts"] == sorted(terms)
    weights = {}
    for r in term_weights(one, "k", "t", vocabulary(one, "t", 30)).collect():
        weights.setdefault(r.k, {})[f"ts_{r.term}"] = pytest.approx(r.weight)
    for r in slots.transform(out).collect():
        got = {slots.names[p]: w for p, w in zip(r.places, r.weights)}
        assert r.places == sorted(r.places) and got.pop("cnt") == sum(1 for k, _, _ in values if k == r.k)
        assert got == weights.get(r.k, {})


@pytest.mark.parametrize("small", [5, 10_000])
def test_quantiles_are_exact(rows, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.exponential(9, 900), np.zeros(700), np.full(400, 3.25), [1e9]])
    df = rows([(float(v),) for v in x], "v double")
    shares = [0.0, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0]
    assert quantiles.quantiles(df, "v", shares) == pytest.approx(list(np.quantile(x, shares)))


def test_gaps_of_a_busy_key(rows):
    random.seed(1)
    start = dt.datetime(2024, 1, 1)
    events = [
        ("hot" if i % 3 else f"c{i % 5}", start + dt.timedelta(seconds=random.randrange(400_000)), i)
        for i in range(3000)
    ]
    df = rows(events, "c string, t timestamp_ntz, id int")
    want, lists = {}, {}
    for c, t, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        before = lists.setdefault(c, [])
        want[i] = int((t - before[-1]).total_seconds()) if before else None
        before.append(t)
    assert {r.id: r.gap for r in gaps(df, "c", "t", "id").collect()} == want
    for r in gap_statistics(df, "c", "t").collect():
        d = [(b - a).total_seconds() for a, b in zip(lists[r.c], lists[r.c][1:])]
        assert r.diff_avg == pytest.approx(np.mean(d))
        assert r.diff_std == pytest.approx(np.std(d), abs=0.0051)


def test_cap_per_class(rows):
    values = [("hot" if i % 3 else "cold", i * 7919 % 5000) for i in range(5000)] + [("few", 1), (None, 3), (None, 2)]
    df = rows(values, "label string, id int")
    got = sorted((str(r.label), r.id) for r in cap_per_class(df, "label", ["id"], 100).collect())
    want = []
    for label in ("hot", "cold", "few", None):
        want += [(str(label), i) for i in sorted(i for c, i in values if c == label)[:100]]
    assert got == sorted(want)


def test_cap_cuts_rows_of_equal_keys(rows):
    df = rows([("a", 1, i) for i in range(30)] + [("a", 2, i) for i in range(500)] + [("b", 7, 0)], "label string, id int, x int")
    got = Counter((r.label, r.id) for r in cap_per_class(df, "label", ["id"], 40).collect())
    assert got == {("a", 1): 30, ("a", 2): 10, ("b", 7): 1}


def test_no_task_ranks_a_class(spark):
    """A million rows in one class, capped at 100,000: the n-th key is found by counting ranges."""
    df = spark.range(1_000_000).select(F.lit("one").alias("label"), F.xxhash64("id").alias("key"))
    out = cap_per_class(df.repartition(16), "label", ["key"], 100_000)
    bound = df.selectExpr("sort_array(collect_list(key))[99999] AS b").first().b
    assert out.agg(F.count("*"), F.max("key")).first()[:] == (100_000, bound)
    assert first_rows(df, ["key"], 20_000).count() == 20_000
    plan = nth_keys(df, "label", ["key"], 100_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "row_number" not in plan  # over one row a range


def test_windows_against_brute_force(rows):
    random.seed(2)
    start = dt.datetime(2024, 1, 1)

    def when():
        return start + dt.timedelta(minutes=random.randrange(6 * 24 * 60))

    log = []
    for i in range(400):
        t = when()
        log.append((random.choice("ab"), t, t + dt.timedelta(minutes=random.randrange(90)), i))
    spans = [(random.choice("abc"), when(), when()) for _ in range(40)]
    spans += spans[:5]
    got = members_of_windows(
        rows(log, "src_ip string, logtime timestamp_ntz, end_time timestamp_ntz, id int"),
        rows(spans, "src_ip string, start_time timestamp_ntz, end_time timestamp_ntz"),
    )
    got = sorted((r.id, r.window_start, r.window_end) for r in got.collect())
    want = sorted(
        (i, s, e) for k, s, e in set(spans) for c, t, u, i in log if c == k and t >= s and u <= e
    )
    assert got == want and want


def test_unlike_feedback_against_brute_force(rows):
    rng = np.random.default_rng(4)
    s, f = rng.normal(size=(120, 6)), rng.normal(size=(30, 6))
    f[7], s[5] = 0, 0
    values = [(i, v.tolist()) for i, v in enumerate(s)] + [(120, None), (121, s[0].tolist())]
    samples = rows(values, "id int, v array<double>")
    verdicts = rows([(v.tolist(),) for v in np.vstack([f, f[:9]])] + [(None,)], "v array<double>")
    live = f[np.linalg.norm(f, axis=1) > 0]
    cos = (s @ live.T) / np.maximum(np.outer(np.linalg.norm(s, axis=1), np.linalg.norm(live, axis=1)), 1e-300)
    want = [i for i in range(len(s)) if cos[i].max() < 0.8]
    want += [120] + [121] * (0 in want)
    out = feedback.unlike_feedback(samples, verdicts, "v", 0.8)
    assert sorted(r.id for r in out.collect()) == want and 0 < len(want) < len(s)
    assert feedback.unlike_feedback(samples, verdicts.where("false"), "v").count() == len(values)


def clustered_vectors(rows, n, seed):
    """Sparse vectors around 40 centres in 30 dimensions, many like one of the others."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(40, 30)) * (np.random.default_rng(2).random((40, 30)) < 0.3)
    x = centres[rng.integers(40, size=n)] + 0.12 * rng.normal(size=(n, 30)) * (rng.random((n, 30)) < 0.3)
    return x, rows([(v.tolist(),) for v in x], "values array<double>").withColumns(sparse(F.col("values")))


@pytest.mark.parametrize("pivots, block", [(32, 2048), (5, 50), (1, 7)])
def test_like_vectors_are_found_with_few_comparisons(rows, pivots, block):
    x, samples = clustered_vectors(rows, 900, 3)
    y, verdicts = clustered_vectors(rows, 700, 4)
    y, verdicts = y[:350], verdicts.limit(350)
    u, v = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    cos = (u @ v.T).max(1)
    keys, found = search(samples, verdicts, 0.95, pivots, block)
    hits = {tuple(r.places) + tuple(r.weights) for r in keys.join(found.where("hit"), "id", "left_semi").collect()}
    want = {tuple(np.flatnonzero(r).tolist()) + tuple(r[r != 0].tolist()) for r, c in zip(x, cos) if c >= 0.95}
    assert hits == want and 100 < len(want) < 900
    compared = found.agg(F.sum("compared")).first()[0]
    if pivots == 32:
        assert compared < 0.08 * len(x) * len(y)


def test_profiles_unlike_feedback_texts(rows):
    """Text slots of keys against those of verdicts, by cosine of their TF-IDF vectors."""
    values = [("a", "red green"), ("a", "blue"), ("b", "red green blue"), ("c", "stone"), ("d", "red"), ("e", None)]
    texts = {"t": Texts(F.col("t"))}
    samples = profile(rows(values, "k string, t string"), ["k"], texts).stored()
    verdicts = profile(rows([("v", "blue red"), ("v", "green")], "k string, t string"), ["k"], texts).stored()
    out = feedback.unlike_profiles(samples, verdicts, ["t"], 0.99)
    assert sorted(r.k for r in out.collect()) == ["c", "d", "e"]


def test_limits_pick_first_keys(data):
    start, end = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
    every = normal_rows(data.http_log, start, end).measures.collect()
    keys = sorted(tuple(r[k] for k in KEYS) for r in every)[:25]
    got = normal_rows(data.http_log, start, end, 25).measures.collect()
    assert sorted(tuple(r[k] for k in KEYS) for r in got) == keys
    full = {}
    for r in attack_rows(data.http_log, data.ip_ast).measures.collect():
        full.setdefault(r.label, []).append(tuple(r[k] for k in KEYS))
    capped = {}
    for r in attack_rows(data.http_log, data.ip_ast, 5).measures.collect():
        capped.setdefault(r.label, []).append(tuple(r[k] for k in KEYS))
    assert {c: sorted(v)[:5] for c, v in full.items()} == {c: sorted(v) for c, v in capped.items()}
