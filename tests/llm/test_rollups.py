import duckdb
import pytest

from wardlog.llm import rollups
from wardlog.llm.queries import ORACLE, QUERIES
from wardlog.session import scratch

SCHEMA = "doc_id bigint, source string, lang string, tokenizer string, change string, n_tokens bigint, extra string"


@pytest.fixture
def ledger(spark):
    return rollups.TokenRollup(spark, scratch(spark, "test-rollup"))


def totals(ledger):
    return sorted((tuple(r) for r in ledger.totals().collect()), key=str)


def test_batches(spark, ledger):
    assert totals(ledger) == [] and ledger.batches() == []
    rows = [
        (1, "a", "en", "t1", "insert", 10, "x"),
        (2, "a", "en", "t1", "insert", 5, None),
        (2, "a", "en", "t2", "insert", 7, None),
        (3, None, None, "t1", "insert", None, None),
        (None, "b", "fr", "t1", "insert", 4, None),
        (4, "b", "fr", "t1", "insert", 2, None),
        (4, "b", "fr", "t1", "insert", 2, None),
    ]
    assert ledger.commit("one", spark.createDataFrame(rows, SCHEMA))
    assert totals(ledger) == sorted([("a", "en", "t1", 2, 15), ("a", "en", "t2", 1, 7), (None, None, "t1", 1, 0), ("b", "fr", "t1", 3, 8)], key=str)
    assert not ledger.commit("one", spark.createDataFrame(rows, SCHEMA))  # a repeated batch changes nothing
    more = [
        (1, "c", "en", "t1", "revise", 12, None),  # moves to another source with another count
        (2, None, None, None, "delete", None, None),  # under every tokenizer
        (9, "z", "en", "t1", "delete", 3, None),  # never there
        (None, "b", "fr", "t1", "delete", 4, None),  # no id: ignored
        (4, None, None, "t1", "delete", None, None),  # both rows
        (8, "c", "en", "t1", "revise", 1, None),  # new by revision
    ]
    assert ledger.commit("two", spark.createDataFrame(more, SCHEMA))
    assert totals(ledger) == sorted([("c", "en", "t1", 2, 13), (None, None, "t1", 1, 0), ("b", "fr", "t1", 1, 4)], key=str)
    assert ledger.batches() == ["one", "two"]
    assert ledger.commit("three", spark.createDataFrame([], SCHEMA))
    assert len(totals(ledger)) == 3


def test_a_batch_that_was_not_finished_does_not_count(spark, ledger):
    row = spark.createDataFrame([(1, "a", "en", "t", 1, 5)], rollups.LEDGER)
    row.write.parquet(f"{ledger.root}/waiting-lost")
    assert totals(ledger) == [] and ledger.batches() == []


def test_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op7_token_rollups"](spark, folder).select("source", "lang", "tokenizer", "documents", "tokens").collect())
    assert got == sorted(con.execute(ORACLE["op7_token_rollups"]).fetchall()) and got


def test_counters(spark, odd_docs):
    rows = odd_docs.select("doc_id", rollups.word_tokens().alias("w"), rollups.piece_tokens().alias("p")).collect()
    by = {r.doc_id: (r.w, r.p) for r in rows}
    assert by[4] == by[5] == by[6] == (0, 0) and by[1] == (40, 80) and by[7][0] == 20_000
    from public_tokenizers import path

    counted = {r.doc_id: r.n_tokens for r in rollups.vocabulary_tokens(odd_docs.where("doc_id < 7"), path("byte_bpe_50k.json")).collect()}
    assert counted[4] == counted[5] == 0 and counted[1] > 40
