"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes inserts documents, deletes them or gives them a revised count.
It is turned into signed rows (what was counted before is taken off again) and
written as one folder of the ledger. Totals are sums over the ledger, so they are
additive and batches can come in any number. A batch that is already there is
not applied again.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id bigint, source string, lang string, tokenizer string, documents bigint, tokens bigint"
CHANGES = ("doc_id", "source", "lang", "tokenizer", "change", "n_tokens")


def word_tokens(text: str | Column = "text") -> Column:
    """Runs of characters other than space and tab to carriage return; 0 for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return _matches(text, r"[^\x20\x09-\x0D]+")


def piece_tokens(text: str | Column = "text") -> Column:
    """Runs of ASCII letters, runs of digits, and every other non-blank character by itself."""
    text = F.col(text) if isinstance(text, str) else text
    return _matches(text, r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.lit(0)).cast("bigint")


def vocabulary_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) by a public tokenizer file (the JSON format of ``tokenizers``)."""

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part["text"].to_pylist()]
                found = tokenizer.encode_batch(texts, add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([len(f.ids) for f in found], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


class TokenRollup:
    """A ledger of signed counts below ``root``, a folder all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def ledger(self) -> DataFrame:
        done = [f"{self.root}/batch={b}" for b in self.batches()]
        if not done:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*done)

    def state(self) -> DataFrame:
        """What each document counts now: rows whose signed documents do not cancel out."""
        keys = ["doc_id", *GROUP]
        now = self.ledger().groupBy(*keys).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return now.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) of groups that still have documents.

        A null source or language is a group of its own.
        """
        sums = self.ledger().groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if its id is already committed.

        ``changes`` has the columns ``CHANGES``; other columns are ignored. change is
        insert (counts are added; a repeated row counts again), delete (all that a
        doc_id counts under the tokenizer, or under every one if that is null, is taken
        off) or revise (the old counts under the tokenizer are replaced, also those of
        another source or language). A null doc_id can be inserted but not deleted or
        revised; a null count is 0. Deleting what is not there changes nothing.

        Rows are written to a folder of their own and moved into place in one step, so
        a lost driver leaves either the whole batch or nothing of it.
        """
        if batch in self.batches():
            return False
        changes = changes.select(*CHANGES)
        added = changes.where(F.col("change").isin("insert", "revise"))
        added = added.where(F.col("doc_id").isNotNull() | (F.col("change") == "insert")).select(
            "doc_id", *GROUP, F.lit(1).cast("bigint").alias("documents"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("tokens")
        )
        gone = changes.where(F.col("change").isin("delete", "revise") & F.col("doc_id").isNotNull())
        gone = gone.select(F.col("doc_id").alias("_id"), F.col("tokenizer").alias("_tokenizer")).distinct()
        old = self.state()
        hit = (F.col("doc_id") == F.col("_id")) & (F.col("_tokenizer").isNull() | (F.col("tokenizer") == F.col("_tokenizer")))
        removed = old.join(gone, hit, "left_semi").select(
            "doc_id", *GROUP, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")
        )
        waiting = f"{self.root}/waiting-{uuid.uuid4().hex}"
        added.unionByName(removed).write.parquet(waiting)
        return bool(self._fs.rename(self._path(waiting), self._path(f"{self.root}/batch={batch}")))
