import itertools
import random

import numpy as np

from wardlog.llm import packing


def padding(lengths, counts, limits):
    return sum(n * (min(x for x in limits if x >= k) - k) for k, n in zip(lengths, counts, strict=True))


def test_limits_have_the_least_padding():
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 30) for _ in lengths]
        for buckets in (1, 2, 3, 4):
            got = packing.best_limits(np.array(lengths), np.array(counts), buckets)
            best = min(
                padding(lengths, counts, [*some, lengths[-1]])
                for k in range(min(buckets, len(lengths)))
                for some in itertools.combinations(lengths[:-1], k)
            )
            assert len(got) <= buckets and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def test_batches_hold_the_budget_and_every_row(table):
    budget = 3_000
    docs = table("documents")
    rows = packing.packed(docs, buckets=6, budget=budget).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    batches: dict = {}
    for r in rows:
        assert r.n_tokens == len((texts[r.doc_id] or "").encode().split()) + 1
        assert r.n_tokens <= r.bucket_limit and r.padding == r.bucket_limit - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rs in batches.values():
        assert len(rs) * rs[0].bucket_limit <= budget or len(rs) == 1
        assert sorted(r.place for r in rs) == list(range(len(rs)))
    for bucket in {b for b, _ in batches}:  # only the last batch of a bucket may have room left
        sizes = [len(batches[k]) for k in sorted(batches) if k[0] == bucket]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]


def test_odd_rows(odd_docs, no_docs):
    rows = packing.packed(odd_docs, buckets=3, budget=100).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.n_tokens for r in rows if r.doc_id in (4, 5, 6)) == [1, 1, 1]
    assert [r.n_tokens for r in rows if r.doc_id == 7] == [20_001]
    assert packing.packed(no_docs).count() == 0


def test_grid(spark):
    got = spark.createDataFrame([(1,), (4096,), (4097,), (20_001,), (10**9 + 1,)], "n bigint").select(packing.grid_length(packing.F.col("n")).alias("g")).collect()
    values = [r.g for r in got]
    assert values[:2] == [1, 4096] and all(n <= g <= n * (1 + 2**-5) for n, g in zip([4097, 20_001, 10**9 + 1], values[2:], strict=True))
