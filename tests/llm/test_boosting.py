import zlib

import numpy as np

from wardlog.llm import boosting


def test_held_out_quality(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        return
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = boosting.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in tested]) > 0.95


def test_labels_of_the_held_out_fold_do_not_matter(table):
    docs, labels = table("documents"), table("labels")
    flipped = labels.selectExpr(
        "doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic"
    )
    score = lambda x: {r.doc_id: r.score for r in boosting.quality_scores(docs, x).collect()}
    assert score(labels) == score(flipped)


def test_odd_rows(odd_docs, no_docs, labels, no_labels):
    rows = boosting.quality_scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    empty = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(empty) == 1
    assert {r.score for r in boosting.quality_scores(odd_docs, no_labels).collect()} == {0.5}
    assert boosting.quality_scores(no_docs, labels).count() == 0
    assert boosting.keep_good(odd_docs, no_labels).count() == odd_docs.count()
    assert boosting.keep_good(odd_docs, labels).columns == odd_docs.columns


def test_arrays_give_what_walking_each_tree_gives():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(boosting.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.fit_trees(x, y)
    assert np.mean((trees.score(x) > 0.5) == (y == 1)) > 0.95

    def walk(row):
        total = trees.start
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])


def test_bound_on_training_rows(table):
    stats = boosting.document_statistics(table("documents"))
    rows = boosting.training_rows(stats, table("labels"), "quality", 10)
    assert rows.count() == 10
