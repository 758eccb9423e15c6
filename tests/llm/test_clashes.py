"""Columns whose names the operators use themselves, and other odd ones."""

import pytest

import corpus_pipeline
from wardlog.llm import boosting, minhash, mixing, pii, sharding

NAMES = [
    "gone", "_gone", "one", "many", "time", "copies", "_copies", "_id", "id", "domain", "spans", "_spans", "new_text", "_text", "terms", "n",
    "digest", "component", "rep", "kept", "score", "predicted", "key", "rank", "row", "_row", "_part", "_at", "_cuts", "_order", "_block", "_n",
    "_g", "_b", "_before", "_place", "a.b", "rate", "n_tokens", "bucket", "batch", "size", "held_out",
]


@pytest.fixture(scope="module")
def clashing(odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    return docs.selectExpr("*", *[f"concat('{n}', cast(doc_id as string)) AS `{n}`" for n in NAMES])


def rows(df):
    return sorted(map(str, df.collect()))


def plain(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def same(out, clashing):
    """Own columns are unchanged: each holds its name and the row's id."""
    assert out.columns[: len(clashing.columns)] == clashing.columns
    for r in out.collect():
        assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in NAMES)


def test_names_may_clash(clashing, labels):
    docs, domains = plain(clashing), mixing.quality_domains(labels)
    weights = {"clean": 0.9, "low": 0.06, "toxic": 0.04}
    for run in (
        minhash.deduplicate,
        lambda d: boosting.keep_good(d, labels),
        pii.redacted,
        lambda d: mixing.resampled(d, domains, weights),
    ):
        out = run(clashing)
        same(out, clashing)
        assert rows(plain(out)) == rows(run(docs))


def test_shards_keep_all_columns(clashing):
    out = sharding.shuffled_shards(clashing, shards=3, seed=1)
    same(out, clashing)
    assert out.columns[-2:] == ["shard", "slot"] and rows(plain(out)) == rows(plain(clashing))


def test_stages_keep_all_columns(spark, clashing, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == clashing.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
