"""Documents made ready for training, in five stages.

Each stage reads what the one before it kept, and its rows are written and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlog.llm import boosting, minhash, mixing, packing, pii
from wardlog.llm.words import own
from wardlog.session import configure, stored

# Target shares of tokens; documents of the clean domain are all kept, so the mix is
# reached by thinning out the others.
MIX = {"clean": 0.97, "low": 0.01, "toxic": 0.02}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return boosting.keep_good(docs, _labels(spark, sf_dir)).select(*own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 80 percent of their five-word shingles in common."""
    return minhash.deduplicate(docs).select(*own(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the tokens of each domain have the shares of ``MIX``."""
    domains = mixing.quality_domains(_labels(spark, sf_dir))
    return mixing.resampled(docs, domains, MIX, anchor="clean", upper=1.0).select(*own(docs))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of each document."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("personal data", private_data),
    ("mixing", mixing_weights),
    ("packing", packs),
]

# A boosted model, likelihood fits and groups of near copies are beyond SQL; the
# stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
