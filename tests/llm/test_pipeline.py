from test_minhash import brute
from test_pii import base

import corpus_pipeline
from wardlog.llm import minhash


def test_stages_on_the_given_tables(spark, table):
    folder, docs = "/root/testdata/sf0.001", table("documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = minhash.stored(stage(spark, docs, folder), f"test-{k}")
        if k < 4:
            assert docs.columns == columns, name
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert kept[name] == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
        if name == "personal data":
            for r in docs.collect():
                assert not base(r.text)
                assert base(texts[r.doc_id]) or r.text == texts[r.doc_id]
    good = {r.doc_id for r in table("labels").where("quality = 1 and toxic = 0").collect()}
    assert len(kept["quality classifier"] & good) >= 0.97 * len(good)
    assert kept["packing"] == kept["mixing"] and docs.columns[:2] == ["doc_id", "n_tokens"]
    low = {r.doc_id for r in table("labels").where("quality = 0").collect()}
    assert len(kept["quality classifier"] & low) <= 0.25 * len(low)  # learned from some 60 labelled rows


def test_run_and_odd_rows(spark, odd_docs, no_docs, labels, no_labels, tmp_path):
    for name, docs, marks in (("odd", odd_docs, labels), ("none", no_docs, no_labels)):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() <= docs.count() and "batch" in out.columns
