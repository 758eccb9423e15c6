"""Sparse features of profiles: numbers, then one slot of TF-IDF weights per text column.

Terms are counted on the long table of texts, so a key of any size has one vector and
no text is ever put together; n-grams do not go from one text to the next. A key's
document in a column is all its texts; equal documents are found by their digests and
count once in the vocabulary. A vector is two arrays, ``places`` (sorted) and
``weights``, without the zeros; nothing dense is written.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import log

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog.functions.text import counted_terms
from wardlog.functions.vectors import constant_array, total
from wardlog.operators.profiles import COLUMN, Profiles
from wardlog.session import scratch


def terms_of(texts: DataFrame, low: int, high: int) -> DataFrame:
    """One row for each term of each text, with how often the text counts."""
    found, kept = counted_terms(F.col("text"), "term", low, high)
    return texts.withColumn("term", F.explode_outer(found)).where(F.col("term").isNotNull() & kept).drop("text")


def documents(profiles: Profiles) -> DataFrame:
    """(column, keys): for each different document of each text column one key that has it."""
    pairs = F.array(*[F.struct(F.lit(c).alias(COLUMN), F.col(f"{c}_digest").alias("digest")) for c in profiles.columns])
    rows = profiles.measures.select(F.struct(*profiles.keys).alias("k"), F.explode(pairs).alias("p"))
    first = rows.groupBy(f"p.{COLUMN}", "p.digest").agg(F.min("k").alias("k"))
    return first.select(COLUMN, *[F.col("k")[k].alias(k) for k in profiles.keys])


def vocabularies(profiles: Profiles, caps: Mapping[str, int], low: int = 1, high: int = 1) -> DataFrame:
    """(column, term, cnt, docs): the most frequent terms of each text column over its different documents."""
    keys = [COLUMN, *profiles.keys]
    chosen = documents(profiles).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = terms_of(profiles.texts.join(chosen, same, "left_semi"), low, high)
    counts = rows.groupBy(*keys, "term").agg(F.sum("n").alias("n"))
    counts = counts.groupBy(COLUMN, "term").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("docs"))
    cap = F.element_at(F.create_map(*[F.lit(v) for item in caps.items() for v in item]), F.col(COLUMN))
    # partial limits keep all but the first terms of each task from the shuffle
    order = Window.partitionBy(COLUMN).orderBy(F.desc("cnt"), "term")
    ranked = counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(caps.values()))
    return ranked.where(F.col("_rank") <= cap).drop("_rank")


@dataclass
class Slots:
    """Number columns, and terms with their weights for each text column."""

    numbers: list[str]
    terms: dict[str, list[str]]
    idf: dict[str, list[float]]
    low: int = 1
    high: int = 1

    @property
    def names(self) -> list[str]:
        return [*self.numbers, *[n for names in self.slots.values() for n in names]]

    @property
    def slots(self) -> dict[str, list[str]]:
        return {c: [f"{c}_{t}" for t in terms] for c, terms in self.terms.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(column, term, place, idf); as long as the caps allow."""
        rows, place = [], len(self.numbers)
        for c, terms in self.terms.items():
            rows += [(c, t, place + i, w) for i, (t, w) in enumerate(zip(terms, self.idf[c], strict=True))]
            place += len(terms)
        return spark.createDataFrame(rows, f"{COLUMN} string, term string, place int, idf double")

    def transform(self, profiles: Profiles) -> DataFrame:
        """Measures with ``places`` and ``weights``. A key without terms has its numbers only."""
        keys = list(profiles.keys)
        rows = terms_of(profiles.texts.where(F.col(COLUMN).isin(*self.terms)), self.low, self.high)
        rows = rows.join(self.table(profiles.measures.sparkSession), [COLUMN, "term"])
        counts = rows.groupBy(*keys, COLUMN, "place", "idf").agg(F.sum("n").alias("tf"))
        entry = F.struct("place", COLUMN, (F.col("tf") * F.col("idf")).alias("w"))
        # a key has at most one entry a term of the vocabularies
        found = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_terms"))
        found = found.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = profiles.measures.join(found, same, "left").drop(*[f"_{k}" for k in keys])
        terms = F.coalesce("_terms", F.array().cast(found.schema["_terms"].dataType))
        lengths = {}
        for c in self.terms:
            square = F.aggregate(terms, F.lit(0.0), lambda a, e: F.when(e[COLUMN] == c, a + e["w"] * e["w"]).otherwise(a))  # noqa: B023
            lengths[f"_length_{c}"] = F.sqrt(square)

        def weight(e: Column) -> Column:
            by = F.lit(1.0)
            for c in self.terms:
                by = F.when(e[COLUMN] == c, F.col(f"_length_{c}")).otherwise(by)
            return F.struct(e["place"].alias("place"), (e["w"] / by).alias("w"))

        numbers = [F.struct(F.lit(i).alias("place"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("w")) for i, c in enumerate(self.numbers)]
        entries = F.transform(terms, weight)
        if numbers:
            entries = F.concat(F.filter(F.array(*numbers), lambda e: e["w"] != 0), entries)
        out = out.withColumns(lengths).withColumn("_entries", entries)
        out = out.withColumns({"places": F.col("_entries.place"), "weights": F.col("_entries.w")})
        return out.drop("_entries", "_terms", *lengths)

    def padded(self, column: str, size: int) -> Column:
        """A text column's slot as ``size`` numbers: its weights in place order, zeros where it has fewer terms."""
        start = len(self.numbers)
        for c, terms in self.terms.items():
            if c == column:
                found = F.map_from_arrays("places", "weights")
                places = F.sequence(F.lit(start), F.lit(start + min(size, len(terms)) - 1))
                have = F.transform(places, lambda p: F.coalesce(F.element_at(found, p), F.lit(0.0)))
                return F.concat(have, F.array_repeat(F.lit(0.0), max(size - len(terms), 0)))
            start += len(terms)
        return F.array_repeat(F.lit(0.0), size)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(json.dumps(vars(self)),)]
        spark.createDataFrame(rows, "slots string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Slots:
        return cls(**json.loads(spark.read.parquet(path).first().slots))


def fit_slots(profiles: Profiles, numbers: Sequence[str], caps: Mapping[str, int], low: int = 1, high: int = 1) -> Slots:
    """Vocabularies of the text columns in ``caps``, weighted by smoothed inverse document counts."""
    vocab = vocabularies(profiles, caps, low, high).collect()  # the caps at most
    sizes = {r[COLUMN]: r.n for r in documents(profiles).groupBy(COLUMN).agg(F.count(F.lit(1)).alias("n")).collect()}
    terms, idf = {}, {}
    for c in caps:
        mine = sorted((r.term, r.docs) for r in vocab if r[COLUMN] == c)
        if mine:
            terms[c] = [t for t, _ in mine]
            idf[c] = [log((1 + sizes[c]) / (1 + docs)) + 1.0 for _, docs in mine]
    return Slots(list(numbers), terms, idf, low, high)


def sparse(values: Column) -> dict[str, Column]:
    """``places`` and ``weights`` of a dense array."""
    pairs = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size(values) - 1).alias("p"), values.alias("w")), lambda e: e["w"] != 0)
    return {"places": pairs["p"], "weights": pairs["w"]}


def times_constant(numbers: Sequence[float]) -> Column:
    """The product of the sparse vector and constant numbers, entry by entry."""
    constant = constant_array(numbers)
    return F.zip_with("places", "weights", lambda p, w: w * F.get(constant, p))


def product(numbers: Sequence[float]) -> Column:
    return total(times_constant(numbers))


def as_vectors(df: DataFrame, size: int) -> DataFrame:
    """Adds ``features``, a sparse vector column, by writing the rows once and reading them as such."""
    layout = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col("places").alias("indices"), F.col("weights").alias("values"),
    )
    path = scratch(df.sparkSession, "vectors")
    df = df.withColumn("features", layout)
    df.write.parquet(path)
    fields = [T.StructField("features", VectorUDT()) if f.name == "features" else f for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
