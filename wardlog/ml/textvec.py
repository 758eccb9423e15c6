"""TF-IDF features from text columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlog.constants import STOP_WORDS
from wardlog.functions.text import WORD, counted_terms, n_grams, words


def vocabulary(
    df: DataFrame, text: str | Column, max_features: int, low: int = 1, high: int = 1
) -> DataFrame:
    """The most frequent terms over the different texts, as (term, cnt, docs).

    A text's terms are sorted in its row, so that the first of equal ones is known and
    counts for the document; only sums by term are shuffled, no (text, term) pairs. Ties
    go by term. The outer explode keeps the optimiser from testing each text for words
    first, which would split it twice.
    """
    text = F.col(text) if isinstance(text, str) else text
    found, kept = counted_terms(F.col("text"), "t.term", low, high)
    texts = df.select(text.alias("text")).distinct().select(F.sort_array(found).alias("terms"))
    # one entry more than terms, which has the last term before it and none of its own
    before = F.concat(F.array(F.lit(None).cast("string")), "terms")
    pairs = F.arrays_zip(F.col("terms").alias("term"), before.alias("before"))
    each = texts.select(F.explode_outer(pairs).alias("t")).where(F.col("t.term").isNotNull() & kept)
    first = ~F.col("t.term").eqNullSafe(F.col("t.before"))
    counts = each.groupBy(F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("cnt"), F.count_if(first).alias("docs"))
    return counts.orderBy(F.desc("cnt"), "term").limit(max_features)


def term_weights(
    df: DataFrame, key: str, text: str, vocab: DataFrame, low: int = 1, high: int = 1
) -> DataFrame:
    """Weights as rows (key, term, tf, weight): tf times smoothed idf, length 1 per key.

    Document counts of ``vocab`` are taken as they are; ``key`` is one text row.
    """
    # two hashes stand for a text, so that texts need not be moved to be counted
    texts = df.select(F.struct(F.xxhash64(text), F.md5(text), F.col(text).isNull()).alias("t")).distinct().agg(F.count(F.lit(1))).scalar()
    tokens = n_grams(words(F.col(text)), low, high)
    # Words outside the vocabulary are dropped before anything is counted or shuffled.
    tf = (
        df.select(key, F.explode_outer(tokens).alias("term"))
        .join(vocab.select("term", "docs"), "term")
        .groupBy(key, "term", "docs")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    idf = F.log((1.0 + texts) / (1.0 + F.col("docs"))) + 1.0
    raw = tf.withColumn("raw", F.col("tf") * idf)
    # A key has at most one row per vocabulary term, so this window stays small.
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", (F.col("raw") / length).alias("weight"))


def token_stages(column: str, low: int, high: int) -> list:
    split = RegexTokenizer(
        inputCol=column, outputCol=f"{column}__all", pattern=WORD, gaps=False, toLowercase=True
    )
    kept = StopWordsRemover(
        inputCol=f"{column}__all", outputCol=f"{column}__1", stopWords=STOP_WORDS,
        caseSensitive=True,
    )
    grams = [
        NGram(n=n, inputCol=f"{column}__1", outputCol=f"{column}__{n}")
        for n in range(max(low, 2), high + 1)
    ]
    parts = ", ".join(f"`{column}__{n}`" for n in range(low, high + 1))
    joined = SQLTransformer(statement=f"SELECT *, concat({parts}) AS `{column}__tok` FROM __THIS__")
    return [split, kept, *grams, joined]


@dataclass
class TextModel:
    """Vocabulary counts and their weighting for one text column."""

    column: str
    terms: list[str]
    counter: PipelineModel
    weigher: PipelineModel

    @property
    def names(self) -> list[str]:
        return [f"{self.column}_{t}" for t in self.terms]

    def count(self, df: DataFrame) -> DataFrame:
        out = self.counter.transform(df)
        spare = [c for c in out.columns if c.startswith(f"{self.column}__") and c not in df.columns]
        return out.drop(*[c for c in spare if c != f"{self.column}__cnt"])

    def weigh(self, df: DataFrame) -> DataFrame:
        return self.weigher.transform(df).drop(f"{self.column}__cnt", f"{self.column}__raw")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``<column>_vec``."""
        return self.weigh(self.count(df))

    def save(self, path: str) -> None:
        self.counter.write().overwrite().save(f"{path}/counter")
        self.weigher.write().overwrite().save(f"{path}/weigher")

    @classmethod
    def load(cls, column: str, path: str) -> TextModel:
        counter = PipelineModel.load(f"{path}/counter")
        return cls(
            column, list(counter.stages[-1].vocabulary), counter,
            PipelineModel.load(f"{path}/weigher"),
        )


def fit_text(
    df: DataFrame, column: str, max_features: int, low: int = 1, high: int = 1
) -> TextModel | None:
    """Fits on the different texts of the column; None where they hold no word."""
    spark = df.sparkSession
    vocab = vocabulary(df, column, max_features, low, high)
    terms = sorted(r.term for r in vocab.select("term").collect())  # max_features at most
    if not terms:
        return None
    vectorizer = CountVectorizerModel.from_vocabulary(
        terms, inputCol=f"{column}__tok", outputCol=f"{column}__cnt"
    )
    counter = PipelineModel([*token_stages(column, low, high), vectorizer])
    counted = counter.transform(df.select(column).distinct())
    idf = IDF(inputCol=f"{column}__cnt", outputCol=f"{column}__idf").fit(counted).idf
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(idf.toArray() + 1.0),
        inputCol=f"{column}__cnt",
        outputCol=f"{column}__raw",
    )
    unit = Normalizer(p=2.0, inputCol=f"{column}__raw", outputCol=f"{column}_vec")
    return TextModel(column, terms, counter, PipelineModel([scale, unit]))


@dataclass
class FeatureModel:
    """Number columns followed by one slot of weights per text column."""

    numbers: list[str]
    texts: list[TextModel]

    @property
    def names(self) -> list[str]:
        return [*self.numbers, *[n for t in self.texts for n in t.names]]

    @property
    def slots(self) -> dict[str, list[str]]:
        return {t.column: t.names for t in self.texts}

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``features``."""
        for t in self.texts:
            df = t.weigh(t.count(df))
        vectors = [f"{t.column}_vec" for t in self.texts]
        assembler = VectorAssembler(
            inputCols=[*self.numbers, *vectors], outputCol="features", handleInvalid="keep"
        )
        return assembler.transform(df).drop(*vectors)

    def save(self, spark: SparkSession, path: str) -> None:
        columns = json.dumps({"numbers": self.numbers, "texts": [t.column for t in self.texts]})
        spark.createDataFrame([(columns,)], "layout string").write.mode("overwrite").parquet(
            f"{path}/layout"
        )
        for t in self.texts:
            t.save(f"{path}/{t.column}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        layout = json.loads(spark.read.parquet(f"{path}/layout").first().layout)
        texts = [TextModel.load(c, f"{path}/{c}") for c in layout["texts"]]
        return cls(layout["numbers"], texts)


def fit_features(
    df: DataFrame,
    numbers: Sequence[str],
    texts: Sequence[str],
    max_features: int | dict[str, int],
    low: int = 1,
    high: int = 1,
) -> FeatureModel:
    # A number for all columns, or one per column as in constants.VOCABULARY_CAPS.
    size = max_features if isinstance(max_features, dict) else {c: max_features for c in texts}
    fitted = [fit_text(df, c, size[c], low, high) for c in texts]
    return FeatureModel(list(numbers), [t for t in fitted if t is not None])
