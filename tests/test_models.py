"""Fitted models by their own properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlog.catalog import models as M
from wardlog.constants import DISPLAY_NAMES
from wardlog.ml.metrics import one_vs_rest
from wardlog.ml.models import ModelBundle, fit_anomaly, fit_bundle, reconstruction_error, routed_scores
from wardlog.ml.scaling import fit_scaler
from wardlog.ml.scoring import STATUS_COLUMNS, explanation_rows, median_with_zeros
from wardlog.ml.slots import sparse
from wardlog.ml.tree import fit_tree, importance_table, node_table, route
from wardlog.operators.ordering import with_split
from wardlog.operators.profiles import united
from wardlog.plans.extraction import attack_rows, normal_rows


@pytest.fixture(scope="module")
def bundle(data):
    return M.bundle(data)


def test_models_beat_the_majority(data):
    """Normal rows of a real window hold attacks too, so this fit takes labelled ones only."""
    log = data.http_log
    rows = united(
        [
            normal_rows(log.where("hash = 'normal'"), M.START, M.END),
            attack_rows(log, data.ip_ast),
        ]
    ).renamed(M.NAMES)
    rows = rows.with_measures(lambda m: with_split(m, ["label", *M.KEYS]))
    models = fit_bundle(M.part_of(rows, "train"), M.VERSION, STATUS_COLUMNS, M.CAPS)
    test = M.part_of(rows, "test")
    routed = M.route(models.prepare(test), models.tree, models.labels).select("label", "route")
    counts = {(r.label, r.route): r["count"] for r in routed.groupBy("label", "route").count().collect()}
    n = sum(counts.values())
    right = sum(c for (y, p), c in counts.items() if y == p)
    majority = sum(c for (y, _), c in counts.items() if y == "normal")
    assert right > majority and right / n > 0.9
    assert all(m.accuracy > 0.9 for m in models.specialists.values())
    assert one_vs_rest(routed, "label", "route").count() >= 4


def test_node_table_is_a_tree(data, bundle, spark):
    nodes = node_table(bundle.tree, bundle.features.names, bundle.labels, spark).collect()
    assert len(nodes) == len(bundle.tree.numbered()) > 3
    by_id = {str(n.node_num): n for n in nodes}
    assert [n.node_num for n in nodes if n.node_from == "-"] == [0]
    for n in nodes:
        leaf = n.node_to_left == "-"
        assert leaf == (n.features == "-") == (n.attack_nm in bundle.labels)
        if n.node_from != "-":
            up = by_id[n.node_from]
            assert str(n.node_num) in (up.node_to_left, up.node_to_right)
            assert n.level == up.level + 1
    assert max(n.level for n in nodes) == bundle.tree.depth


def test_importance_adds_up(bundle, spark):
    table = importance_table(bundle.tree, bundle.features.names, 334, M.START, spark).collect()
    assert [r.feature for r in table] == bundle.features.names
    assert sum(r.value for r in table) == pytest.approx(1.0)


def test_saved_models_score_alike(data, bundle, spark, tmp_path):
    bundle.save(spark, str(tmp_path))
    again = ModelBundle.load(spark, str(tmp_path), bundle.version)
    columns = [*M.KEYS, "route", *bundle.labels]
    rows = M.window_rows(data)
    a = sorted(map(str, bundle.score(rows).select(*columns).collect()))
    b = sorted(map(str, again.score(rows).select(*columns).collect()))
    assert a == b and again.threshold == bundle.threshold


def dense(df, size):
    """The sparse vectors as rows of an array, with the other columns."""
    found = df.collect()
    x = np.zeros((len(found), size))
    for i, r in enumerate(found):
        x[i, r.places] = r.weights
    return found, x


def test_scaled_training_rows_lie_in_unit_range(data, bundle):
    size = len(bundle.features.names)
    rows, x = dense(bundle.prepare(M.part_of(M.extracted(data), "train")), size)
    assert x.min() >= 0 and x.max() <= 1 + 1e-12 and (x.max(0) > 0).sum() > 50
    assert all(list(r.features.indices) == r.places and list(r.features.values) == r.weights for r in rows)
    assert max(len(r.places) for r in rows) < size / 2


def test_scaling_of_sparse_rows_equals_that_of_dense_ones(rows):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 9)) * (rng.random((60, 9)) < 0.4), 3)
    x[:, 0] = rng.normal(size=60) + 9
    x[:, 1], x[:, 2], x[:, 3] = 5, 0, np.abs(x[:, 3])
    df = rows([(v.tolist(),) for v in x], "values array<double>").withColumns(sparse(F.col("values")))
    scaler = fit_scaler(df, 9)
    width = x.max(0) - x.min(0)
    want = (x - x.min(0)) / np.where(width > 0, width, 1)
    got_rows, got = dense(scaler.transform(df), 9)
    order = [x.tolist().index(r["values"]) for r in got_rows]
    assert got == pytest.approx(want[order]) and all(0 not in r.weights for r in got_rows)


def test_reconstruction_error(data, bundle):
    prepared = reconstruction_error(bundle.prepare(M.window_rows(data)), bundle.anomaly)
    got, x = dense(prepared, len(bundle.features.names))
    p, mean = np.array(bundle.anomaly.components).T, np.array(bundle.anomaly.mean)
    for r, row in zip(got[:50], x):
        away = row - mean
        assert r.recon_error == pytest.approx(np.mean((away - p @ (p.T @ away)) ** 2), abs=1e-9)


def test_components_are_those_of_the_covariance(rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)) * (rng.random((300, 40)) < 0.3) @ np.diag(np.linspace(3, 1, 40)) + 2
    df = rows([(v.tolist(),) for v in x], "values array<double>").withColumns(sparse(F.col("values"))).repartition(4)
    got = fit_anomaly(df, 40, 4)
    assert got.mean == pytest.approx(x.mean(0).tolist())
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for j, c in enumerate(got.components):
        assert abs(np.array(c) @ vectors[:, -1 - j]) == pytest.approx(1, abs=1e-4)


def test_points_on_a_line_off_the_origin_have_no_error(spark):
    rows = spark.range(50).select(F.array(F.lit(5.0) + F.col("id"), F.lit(40.0) - 2 * F.col("id")).alias("values"))
    rows = rows.withColumns(sparse(F.col("values")))
    out = reconstruction_error(rows, fit_anomaly(rows, 2, 1)).agg(F.max("recon_error").alias("m"))
    assert out.first().m < 1e-9


def test_only_the_routed_specialist_scores(data, bundle):
    scored, x = dense(bundle.score(M.window_rows(data)), len(bundle.features.names))
    for r, row in zip(scored, x):
        for c in bundle.labels:
            if c != r.route:
                assert r[c] == 0
        if r.route != "normal":
            m = bundle.specialists[r.route]
            want = 1 / (1 + np.exp(-(np.dot(row, m.weights) + m.intercept)))
            assert r[r.route] == pytest.approx(want)
    assert routed_scores(bundle.specialists) is not None


def test_explanations_are_sorted_and_centred(data, bundle):
    size = len(bundle.features.names)
    scored, x = dense(bundle.score(M.window_rows(data)), size)
    values = {tuple(r[k] for k in M.KEYS[:3]): row for r, row in zip(scored, x)}
    rows = explanation_rows(bundle.score(M.window_rows(data)), bundle, 334).collect()
    assert rows and len(values) == len(scored)
    names = {v: k for k, v in DISPLAY_NAMES.items()}
    by_source = {}
    for key, row in values.items():
        by_source.setdefault(key[:2], []).append(row)
    for r in rows[:20]:
        assert sorted(r.score, reverse=True) == r.score and len(r.feature) == len(set(r.feature))
        weights = np.array(bundle.specialists[names[r.prediction]].weights)
        wanted = []
        for row in by_source[r.logtime, r.src_ip]:
            parts = row * weights
            wanted.append({n: p - np.median(parts) for n, p, v in zip(bundle.features.names, parts, row) if v})
            wanted[-1]["rest"] = -np.median(parts)
        got = {**dict(zip(r.feature, r.score)), "rest": r.rest}
        assert any(got.keys() == w.keys() and all(got[k] == pytest.approx(w[k], abs=1e-12) for k in w) for w in wanted)


def gini_tree(x, y, depth):
    """Best splits by brute force: (feature, threshold, left, right) or the class counts."""
    counts = [int((y == c).sum()) for c in range(3)]
    whole = len(y) - sum(c * c for c in counts) / len(y)
    best = None
    for f in range(x.shape[1]) if depth else ():
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            total = 0
            for side in (x[:, f] <= low, x[:, f] > low):
                total += side.sum() - sum(((y == c) & side).sum() ** 2 for c in range(3)) / side.sum()
            key = (round(total, 9), f, low, high)
            if key[0] < round(whole, 9) and (best is None or key < best):
                best = key
    if best is None:
        return counts
    _, f, low, high = best
    left = x[:, f] <= low
    return f, (low + high) / 2, gini_tree(x[left], y[left], depth - 1), gini_tree(x[~left], y[~left], depth - 1)


def as_tuple(node):
    return node.counts if node.left is None else (node.feature, node.threshold, as_tuple(node.left), as_tuple(node.right))


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_splits_are_exact(rows, depth):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(250, 6)), 1) * (rng.random((250, 6)) < 0.5)
    x[:, 4], x[:, 5] = 3, rng.normal(size=250)
    y = (x[:, 0] + x[:, 1] > 0.3).astype(int) + (rng.random(250) < 0.2)
    df = rows([("abc"[c], v.tolist()) for c, v in zip(y, x)], "label string, values array<double>")
    df = df.withColumns(sparse(F.col("values"))).repartition(6)
    tree = fit_tree(df, ["a", "b", "c"], depth)
    assert as_tuple(tree) == gini_tree(x, y, depth) and tree.depth <= depth
    routed = route(df, tree, ["a", "b", "c"]).groupBy("route").count().collect()
    leaves = [n for _, _, _, n in tree.numbered() if n.left is None]
    assert sum(n.rows for n in leaves) == sum(r["count"] for r in routed) == 250


def test_tree_of_one_class(rows):
    df = rows([("a", [1.0, float(i)]) for i in range(5)], "label string, values array<double>").withColumns(sparse(F.col("values")))
    assert as_tuple(fit_tree(df, ["a"], 3)) == [5]
    assert as_tuple(fit_tree(df.where("false"), ["a"], 3)) == [0]


def test_median_counts_the_zeros(rows):
    lists = [[], [1.0], [-1.0, -2.0, -3.0], [4.0, 1.0, 2.0], [-1.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]]
    for size in (6, 7):
        df = rows([(v,) for v in lists], "v array<double>").select("v", median_with_zeros(F.col("v"), size).alias("m"))
        for r in df.collect():
            assert r.m == np.median(r.v + [0.0] * (size - len(r.v)))
