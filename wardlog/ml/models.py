"""Specialist classifiers, the anomaly model and the versioned bundle of all models."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.constants import DISPLAY_NAMES
from wardlog.functions.vectors import total
from wardlog.ml.scaling import Scaler, box_threshold, fit_scaler
from wardlog.ml.slots import Slots, as_vectors, fit_slots, product
from wardlog.ml.tree import Node, class_names, fit_tree, load_tree, route, save_tree
from wardlog.operators.ordering import hash_slot
from wardlog.operators.profiles import Profiles
from wardlog.session import scratch
from wardlog.sources.sinks import write_snapshot


def binary_set(df: DataFrame, attack: str, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Rows of one attack (target 1) and normal rows (0), in hash order of their keys."""
    rows = df.where(F.col(label).isin(attack, "normal"))
    rows = rows.withColumn("target", (F.col(label) == attack).cast("double"))
    return rows.withColumn("slot", hash_slot(keys, 1_000_000))


@dataclass
class Linear:
    """A logistic classifier as numbers."""

    weights: list[float]
    intercept: float
    losses: list[float]
    accuracy: float


def fit_specialist(df: DataFrame, attack: str, max_iter: int = 20, penalty: float = 1e-4, tolerance: float = 1e-6) -> Linear:
    """A logistic classifier of one attack against normal rows, from the vectors ``features``."""
    rows = df.where(F.col("label").isin(attack, "normal"))
    rows = rows.withColumn("target", (F.col("label") == attack).cast("double"))
    model = LogisticRegression(
        featuresCol="features", labelCol="target", maxIter=max_iter, regParam=penalty,
        standardization=False, tol=tolerance,
    ).fit(rows)
    return Linear(
        [float(x) for x in model.coefficients.toArray()],
        float(model.intercept),
        [float(x) for x in model.summary.objectiveHistory],
        float(model.summary.accuracy),
    )


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def routed_scores(specialists: dict[str, Linear], by: str = "route") -> Column:
    """The score of the one specialist the row is routed to, from its sparse vector."""
    score = F.lit(None).cast("double")
    for name, model in specialists.items():
        score = F.when(F.col(by) == name, sigmoid(product(model.weights) + model.intercept)).otherwise(score)
    return score


@dataclass
class Anomaly:
    """Principal components (a row a component) of normal rows, and the mean those are measured from."""

    components: list[list[float]]
    mean: list[float]

    def projected(self) -> list[Column]:
        """Components of a sparse row less the mean, without making the row dense."""
        middle = np.array(self.components) @ np.array(self.mean)
        return [product(c) - float(m) for c, m in zip(self.components, middle, strict=True)]


SPARE, PASSES, STILL = 8, 30, 1e-11


def fit_anomaly(normal: DataFrame, size: int, k: int) -> Anomaly:
    """The ``k`` first principal components of sparse rows of ``size`` places.

    Subspace iteration with ``SPARE`` more directions: each pass multiplies the covariance
    by a thin matrix, X'(X V - 1 mean'V) with the mean taken off implicitly, in tasks that
    add up their part of it; the driver sees a matrix of ``size`` x (k + SPARE) numbers.
    """
    normal = normal.select("places", "weights")
    rows = normal.count()
    entries = normal.select(F.explode(F.arrays_zip("places", "weights")).alias("e"))
    mean = np.zeros(size)
    for r in entries.groupBy("e.places").agg(F.sum("e.weights").alias("w")).collect():
        mean[r.places] = r.w / rows
    width = min(size, k + SPARE)
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(size, width)))[0]
    for _ in range(PASSES):
        moved = _covariance_times(normal, basis, mean, width) / rows
        inner = basis.T @ moved
        left = moved - basis @ inner
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = turn[:, ::-1]
        found = basis @ turn[:, :k]
        # done when the covariance keeps the wanted directions
        if np.linalg.norm(left @ turn[:, :k]) <= STILL * max(values[-1], 1e-300):
            break
        basis = np.linalg.qr(moved)[0]
    signs = np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    found = found * np.where(signs == 0, 1, signs)
    return Anomaly(found.T.tolist(), mean.tolist())


def _covariance_times(rows: DataFrame, basis: np.ndarray, mean: np.ndarray, width: int) -> np.ndarray:
    columns = [f"y{j}" for j in range(width)]
    middle = mean @ basis

    def part(batches):
        out, ahead = np.zeros_like(basis), np.zeros(width)
        for batch in batches:
            size = pc.list_value_length(batch["places"]).to_numpy(zero_copy_only=False).astype(np.int64)
            place, w = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("places", "weights"))
            owner = np.repeat(np.arange(batch.num_rows), size)
            for j in range(width):
                along = np.bincount(owner, basis[place, j] * w, batch.num_rows) - middle[j]
                out[:, j] += np.bincount(place, w * along[owner], len(out))
                ahead[j] += along.sum()
        out -= np.outer(mean, ahead)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *[pa.array(x) for x in out.T.copy()]], ["place", *columns])

    made = rows.mapInArrow(part, ", ".join(["place int", *[f"{c} double" for c in columns]]))
    total = np.zeros_like(basis)
    for r in made.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        total[r.place] = r[1:]
    return total


def reconstruction_error(df: DataFrame, model: Anomaly) -> DataFrame:
    """Adds ``recon_error``, the mean squared error of projecting onto the components.

    The components are orthonormal, so the squared error is what the row's squared
    distance from the mean loses by the projection; no row is rebuilt or made dense.
    """
    mean = np.array(model.mean)
    square = total(F.transform("weights", lambda w: w * w)) - 2 * product(model.mean) + float(mean @ mean)
    lost = square
    for z in model.projected():
        lost = lost - z * z
    return df.withColumn("recon_error", F.greatest(lost, F.lit(0.0)) / float(len(mean)))


def projection(df: DataFrame, model: Anomaly) -> DataFrame:
    """Adds x, y and z, as many as the model has components; the mean is at the origin."""
    return df.withColumns(dict(zip("xyz", model.projected())))


@dataclass
class ModelBundle:
    """Everything scoring needs, stored under one version."""

    version: str
    labels: list[str]
    features: Slots
    scaler: Scaler
    tree: Node
    specialists: dict[str, Linear]
    anomaly: Anomaly | None
    threshold: float

    def prepare(self, profiles: Profiles) -> DataFrame:
        """Measures with scaled sparse features."""
        return as_vectors(self.scaler.transform(self.features.transform(profiles)), len(self.features.names))

    def score(self, profiles: Profiles) -> DataFrame:
        """Adds ``route`` and one score column per class, 0 off the route."""
        out = route(self.prepare(profiles), self.tree, self.labels)
        if self.anomaly is not None:
            out = reconstruction_error(out, self.anomaly)
        else:
            out = out.withColumn("recon_error", F.lit(0.0))
        if self.specialists:
            out = out.withColumn("attack_score", routed_scores(self.specialists))
        else:
            out = out.withColumn("attack_score", F.lit(0.0))
        return spread_scores(out, self.labels)

    def save(self, spark: SparkSession, root: str) -> str:
        path = f"{root}/model_ver={self.version}"
        self.features.save(spark, f"{path}/features")
        self.scaler.save(spark, f"{path}/scaler")
        save_tree(spark, self.tree, f"{path}/tree")
        meta = {
            "labels": self.labels,
            "threshold": self.threshold,
            "anomaly": None if self.anomaly is None else vars(self.anomaly),
            "specialists": {n: vars(m) for n, m in self.specialists.items()},
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode(
            "overwrite"
        ).parquet(f"{path}/meta")
        return path

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: str) -> ModelBundle:
        path = f"{root}/model_ver={version}"
        meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
        return cls(
            version,
            meta["labels"],
            Slots.load(spark, f"{path}/features"),
            Scaler.load(spark, f"{path}/scaler"),
            load_tree(spark, f"{path}/tree"),
            {n: Linear(**m) for n, m in meta["specialists"].items()},
            None if meta["anomaly"] is None else Anomaly(**meta["anomaly"]),
            meta["threshold"],
        )


def spread_scores(
    df: DataFrame, labels: Sequence[str], by: str = "route",
    attack_score: str = "attack_score", error: str = "recon_error",
) -> DataFrame:
    """One column per class: the routed score, 0 for the other classes."""
    out = {}
    for name in labels:
        value = F.col(error if name == "normal" else attack_score)
        out[name] = F.coalesce(F.when(F.col(by) == name, value), F.lit(0.0))
    return df.withColumns(out)


def fit_bundle(
    train: Profiles,
    version: str,
    numbers: Sequence[str],
    caps: Mapping[str, int],
    depth: int = 5,
    low: int = 1,
    high: int = 1,
    components: int = 5,
) -> ModelBundle:
    """Fits text features, scaler, tree, specialists, anomaly model and threshold.

    ``train`` has a measure or key ``label``; ``caps`` names its text columns and the sizes
    of their vocabularies. The extracted profiles and the sparse vectors are each written
    once to the shared folder and read back for every fit, so a lost executor costs a
    re-read and not the extraction.
    """
    spark = train.measures.sparkSession
    train = train.stored("extracted")
    features = fit_slots(train, numbers, caps, low, high)
    size = len(features.names)
    ready = features.transform(train).select("label", "places", "weights")
    ready = write_snapshot(ready, scratch(spark, "sparse"), version)
    scaler = fit_scaler(ready, size)
    ready = as_vectors(scaler.transform(ready), size)
    labels = class_names(ready)
    tree = fit_tree(ready, labels, depth)
    normal = ready.where(F.col("label") == "normal")
    has_normal = "normal" in labels
    attacks = [c for c in labels if c != "normal"]
    specialists = {c: fit_specialist(ready, c) for c in attacks} if has_normal else {}
    anomaly = fit_anomaly(normal, size, min(components, size)) if has_normal else None
    bundle = ModelBundle(version, labels, features, scaler, tree, specialists, anomaly, 0.0)
    if has_normal:
        routed = route(ready, tree, labels)
        scored = reconstruction_error(routed, anomaly)
        bundle.threshold = box_threshold(
            scored.select(F.when(F.col("route") == "normal", F.col("recon_error")).otherwise(0.0)
                          .alias("normal")),
            "normal",
        )
    return bundle


def epoch_metrics(bundle: ModelBundle, spark, model_id: int, logtime: str) -> DataFrame:
    """Loss per iteration and the final accuracy of each specialist."""
    rows = [
        (model_id, DISPLAY_NAMES.get(name, name.upper()), i + 1, loss, m.accuracy)
        for name, m in bundle.specialists.items()
        for i, loss in enumerate(m.losses)
    ]
    schema = "model_id bigint, attack_name string, epochs bigint, loss double, accuracy double"
    return spark.createDataFrame(rows, schema).withColumn(
        "logtime", F.lit(logtime).cast("timestamp_ntz")
    )
