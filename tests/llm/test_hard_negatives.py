import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlog.llm import hard_negatives as H
from wardlog.llm.queries import QUERIES

SHAPE = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every=100, k=5, m=10, low=30, high=90, scale=256):
    """All anchors against all rows."""
    good = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (str(label), len(v), [math.floor(scale * x) for x in v])
            good[i] = min(good.get(i, row), row)
    out = []
    for a, (label, width, v) in good.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, size, w) in good.items() if i != a and size == width)
        for p, i, other in [s for s in scores if s[2] == label][:k]:
            met = [s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:m]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j, _) in enumerate(met, 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in H.hard_negatives(df, **options).collect())


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(12, size=n)] + 0.15 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("block, group, page", [(2048, 2048, 1024), (16, 3, 5)])
def test_against_brute_force(spark, block, group, page):
    rows = clustered(500, 6, 1)
    rows += [(500 + i, [0.0] * 6, i % 4) for i in range(10)] + [(510 + i, rows[0][1], i % 4) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    want = brute(rows, every=20)
    assert len(want) > 500
    assert found(df, every=20, block=block, group=group, page=page) == want


def test_negative_scores_and_other_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.integers(2))) for i in range(120)]
    df = spark.createDataFrame(rows, SHAPE)
    options = {"every": 5, "positives": 3, "negatives": 4, "least_percent": 0, "most_percent": 100}
    assert found(df, block=8, **options) == brute(rows, 5, 3, 4, 0, 100)


def test_blocks_are_left_out_by_their_bounds(spark):
    """On clustered vectors few blocks are read, and no row of the result is missed."""
    rows = clustered(3000, 4, 2)
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    usable = H.usable(df, 256, "vec_id", "embedding", "label")
    blocks = H.in_blocks(usable, 32, 4)
    zones = H.zone_maps(blocks).cache()
    count, n = zones.count(), zones.agg(F.sum("n")).first()[0]
    assert n == 3000 and count >= 3000 / 32
    anchors = usable.where("id % 100 = 0").select(
        F.lit(0).alias("group"), F.col("id").alias("anchor"), "label", "width", "v", F.array(F.lit(0)).alias("tags"),
        F.array(F.lit(-H.FAR + 1)).alias("floors"), F.array(F.lit(H.FAR)).alias("ceilings"),
    )
    chosen = H.choose(anchors, zones, 6, True, 1024).count()
    assert chosen < 0.35 * count / 4 * 30  # of the blocks of its label, an anchor reads about a third at most
    assert found(df, block=32) == brute(rows)


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    x, a = rng.integers(-300, 300, (400, 7)), rng.integers(-300, 300, (20, 7))
    low, high = x.min(0)[None], x.max(0)[None]
    least, most = H.intervals(a, low, high)
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    big = np.full((1, 2), 2**30)
    assert H.products(big, big)[0, 0] == 2**61


def test_neighbours_on_the_curve_are_neighbours_in_space():
    """The curve visits every point of a grid once, and steps go to a neighbouring point."""
    for dim, bits in ((2, 3), (3, 2), (1, 4)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij")
        points = np.stack([a.ravel() for a in axes], 1)
        keys = [k.tobytes() for k in H.hilbert_keys(points, bits)]
        assert len(set(keys)) == len(points)
        walked = points[sorted(range(len(points)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.3, 0.2], 2), (2, [0.3, 0.2], 2), (3, [0.2, 0.2], None), (4, None, 1), (5, [nan, 1.0], 2),
        (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (None, [0.5, 0.5], 2), (8, [0.5], 1), (9, [], 1), (100, [], 2), (10, [0.4, 0.3], 2), (10, [0.1, 0.3], 2),
        (200, [0.5], 2), (11, [0.7], 2), (12, [0.3], 1),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    assert found(df) == brute(rows) and found(df)
    extra = df.selectExpr("*", "'x' AS id", "1 AS block", "2 AS part", "3 AS `group`", "4 AS v", "5 AS anchor", "6 AS width", "7 AS tag")
    assert found(extra) == brute(rows)
    assert found(df.where("false")) == [] and found(df.where("vec_id = 0")) == []


def test_whole_table(spark, table):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table("embeddings").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_hilbert_hard_negatives"](spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows) and got
