import math

import numpy as np

from wardlog.llm import quantised


def brute(rows, cosine):
    good = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, label = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    pairs = []
    for i, (a, x, k) in enumerate(good):
        for b, y, m in good[:i]:
            if k == m and len(x) == len(y):
                x64, y64 = np.array(x, float), np.array(y, float)
                if x64 @ y64 / (np.sqrt(x64 @ x64) * np.sqrt(y64 @ y64)) >= cosine:
                    pairs.append((a, b))
                    links[a] += 1
                    links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (links[i], label[i]) for i in links}


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, dim))
    return [
        (i, [float(np.float32(v)) for v in centres[rng.integers(len(centres))] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3])], int(rng.integers(3)))
        for i in range(n)
    ]


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in quantised.near_vectors(df, 0.93).collect()}


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quantised, "LIST_ROWS", 16)
    monkeypatch.setattr(quantised, "BLOCK", 20)
    rows = vectors(600, 16, 2)
    want = brute(rows, 0.93)
    got = found(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4))
    assert sum(n for n, _ in want.values()) > 300
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold


def test_many_lists_lose_no_pair(spark, monkeypatch):
    """Data of few dimensions in 64, many lists: neighbours lie in directions that random ones hardly show."""
    monkeypatch.setattr(quantised, "LIST_ROWS", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 5)) @ rng.normal(size=(5, 64)) + 0.05 * rng.normal(size=(1200, 64))
    rows = [(i, [float(np.float32(v)) for v in row], 1) for i, row in enumerate(x)]
    u = quantised.unit(np.array([r[1] for r in rows]))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    groups = quantised.local_groups(len(u), *np.nonzero(near))
    got = found(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4))
    assert near.sum() > 2_000
    assert got == {i: (int(near[i].sum()), int(groups[i])) for i in range(len(u))}


def test_one_hot_vector_and_given_table(spark, table):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(500)] + [(900, [2.0, 4.0, 6.0], 1), (901, [1.0, 2.0, 3.0], 2)]
    got = found(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert got[0] == got[499] == got[900] == (500, 0) and got[901] == (0, 901)
    given = [tuple(r) for r in table("embeddings").select("vec_id", "embedding", "label").collect()]
    assert found(table("embeddings")) == brute(given, 0.93)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1, "x"), (2, [], 1, "x"), (3, [0.0, 0.0], 1, "x"), (4, [1.0, None], 1, "x"), (5, [nan, 1.0], 1, "x"),
        (6, [inf, 1.0], 1, "x"), (7, [1.0, 1.0], None, "x"), (8, [1.0, 1.0], 1, None), (9, [1.0, 1.0], 1, "x"),
        (9, [1.0, 1.0], 1, "x"), (10, [1.0, 1.0, 0.0], 1, "x"), (None, [1.0, 1.0], 1, "x"), (11, [2.0, 2.0], 1, "x"),
    ]
    out = quantised.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, id string")).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10))
    assert by[8] == (3, 8, True) and by[9] == (3, 8, False) and by[11] == (3, 8, False) and by[None] == (0, None, True)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert quantised.near_vectors(empty).count() == 0
