import numpy as np

from wardlog.llm import ranks, sharding
from pyspark.sql import functions as F


def test_matrix_has_the_given_sums_and_the_hypergeometric_mean():
    counts = [5, 0, 40, 17, 3]
    m = sharding.communication_matrix(counts, 4, 1)
    assert m.sum(1).tolist() == counts and sorted(m.sum(0)) == [16, 16, 16, 17]
    mean = np.mean([sharding.communication_matrix(counts, 4, s)[2] for s in range(600)], axis=0)
    assert np.allclose(mean, 40 * sharding.shard_sizes(65, 4) / 65, atol=0.35)


def test_draws_beyond_the_library_limit():
    rng = np.random.default_rng(0)
    got = np.array([sharding._hypergeometric(rng, 2 * 10**9, 6 * 10**9, 10**6) for _ in range(300)])
    assert abs(got.mean() - 250_000) < 5 * 433 / 300**0.5 and 300 < got.std() < 580


def test_every_row_has_its_own_place(table, spark):
    docs = table("documents").repartition(5)
    rows = sharding.shuffled_shards(docs.select("doc_id"), 24, 3).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_odd_rows(odd_docs, no_docs, tmp_path, spark):
    out = sharding.shuffled_shards(odd_docs, 5, 1)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns == [*odd_docs.columns, "shard", "slot"]
    assert sharding.shuffled_shards(no_docs, 5).count() == 0
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_ranks_have_no_gaps_in_small_blocks(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then null else 'g' end as g")
    got = ranks.gapless_ranks(df, "g", F.xxhash64("id"), block_rows=30).collect()
    for g in (None, "g"):
        places = sorted(r["rank"] for r in got if r.g == g)
        assert places == list(range(len(places)))
