import numpy as np
from pyspark.sql import functions as F

from wardlog.llm import mixing

WEIGHTS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}


def brute_rates(n, p, goal, lower, upper, floor):
    """The same projected gradient with plain arrays."""
    have, summed, last = n @ p, np.zeros(p.shape[1]), None
    for _ in range(mixing.STEPS):
        rate = np.clip(1 - p @ summed, np.maximum(lower, floor), upper)
        off = (rate * n) @ p - goal
        still = last is not None and (abs(off - last) <= mixing.CLOSE * goal.sum()).all()
        if still or (abs(off) <= mixing.CLOSE * goal.sum()).all():
            break
        last = off
        summed = summed + np.divide(off, have, out=np.zeros_like(off), where=have > 0)
    return rate


def test_rates_reach_the_targets(table):
    domains = mixing.quality_domains(table("labels"))
    rows = mixing.mixed(table("documents"), domains, WEIGHTS).orderBy("doc_id").collect()
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in WEIGHTS] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all() and len(rows) == table("documents").count()
    goal = n.sum() * np.array(list(WEIGHTS.values()))
    assert np.allclose((rate * n) @ p, goal, rtol=1e-3)
    assert np.allclose(rate, brute_rates(n, p, goal, 0.0, np.inf, 0.0), atol=1e-6)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def unsure(spark, rows=3000):
    """Documents whose likelihoods say little."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([4.0, 1.5, 1.0], rows) * 0.7 + np.array([0.2, 0.06, 0.04])
    n = rng.integers(1, 500, rows)
    return n, p, spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens bigint, p_clean double, p_low double, p_toxic double")


def test_unsure_documents_reach_the_targets(spark):
    n, p, df = unsure(spark)
    weights = {"clean": 0.8, "low": 0.12, "toxic": 0.08}
    rate = np.array([r.rate for r in mixing.fitted_rates(df, weights, None, 0.0, None).collect()])
    assert np.allclose((rate * n) @ p, n.sum() * np.array(list(weights.values())), rtol=1e-6) and (rate >= 0).all()


def test_nearest_rates_and_what_is_left(spark, caplog):
    n, p, df = unsure(spark, 500)
    goal = n.sum() * np.array([0.97, 0.02, 0.01])
    rate = np.array([r.rate for r in mixing.fitted_rates(df, {"clean": 0.97, "low": 0.02, "toxic": 0.01}, None, 0.2, 1.5).collect()])
    have, slow = n @ p, np.ones(len(n))
    for _ in range(20_000):  # plain projected gradient
        slow = np.clip(slow - p @ (((slow * n) @ p - goal) / have), 0.2, 1.5)
    distance = lambda r: ((((r * n) @ p - goal) ** 2) / have).sum()
    assert distance(rate) <= distance(slow) * (1 + 1e-5) and rate.min() >= 0.2 and rate.max() <= 1.5
    assert "no rates are nearer" in caplog.text


def test_anchor_keeps_its_documents(table):
    domains = mixing.quality_domains(table("labels"))
    options = {"anchor": "clean", "upper": 1.0}
    rows = mixing.mixed(table("documents"), domains, {"clean": 0.97, "low": 0.01, "toxic": 0.02}, **options).collect()
    assert all(r.copies == 1 and r.rate == 1 for r in rows if r.p_clean >= max(r.p_low, r.p_toxic))
    assert any(r.copies == 0 for r in rows)
    kept = mixing.resampled(table("documents"), domains, WEIGHTS, **options)
    assert kept.columns == table("documents").columns


def test_classifier(spark):
    rows = [(i, f"good plain words {i} here" if i % 3 else f"buy | cheap | pills {i} now") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labelled = docs.where("doc_id < 200").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "spam").otherwise("fine").alias("domain"))
    got = mixing.mixed(docs, labelled, {"fine": 0.5, "spam": 0.5}).collect()
    assert all((r.p_spam > 0.9) == (r.doc_id % 3 == 0) for r in got)


def test_odd_rows(odd_docs, no_docs, labels, no_labels):
    domains, none = mixing.quality_domains(labels), mixing.quality_domains(no_labels)
    assert mixing.mixed(odd_docs, domains, WEIGHTS).count() == odd_docs.count()
    equal = mixing.mixed(odd_docs, none, WEIGHTS).collect()
    assert all(abs(r.p_clean - 1 / 3) < 1e-9 for r in equal)
    assert mixing.mixed(no_docs, domains, WEIGHTS).count() == 0
    drawn = mixing.resampled(odd_docs, domains, WEIGHTS)
    assert drawn.columns == odd_docs.columns and drawn.where("doc_id is null").count() == 2
    assert mixing.resampled(no_docs, domains, WEIGHTS).count() == 0
