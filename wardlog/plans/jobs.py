"""Training and prediction as jobs that a registry row configures.

``train`` fits and saves a model version and files its tree, importance, metrics and
history; ``predict`` scores a window with the newest version and files results, their
text copy, evidence and explanations. Each is one run: repeated, it changes nothing.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wardlog.functions.times import run_window
from wardlog.functions.vectors import display_name
from wardlog.ml.metrics import one_vs_rest
from wardlog.ml.models import ModelBundle, epoch_metrics, fit_bundle
from wardlog.ml.scoring import (
    STATUS_COLUMNS,
    as_text_copy,
    evidence_rows,
    explanation_rows,
    final_labels,
    mark_anomalies,
    result_rows,
)
from wardlog.ml.tree import importance_table, node_table, route, stamped_nodes
from wardlog.operators.ordering import with_split
from wardlog.plans.extraction import KEYS, prediction_rows, training_rows
from wardlog.session import stored
from wardlog.sources.runs import RunTables
from wardlog.sources.sinks import training_history
from wardlog.sources.tables import run_config

TEXT_COLUMNS = {"agent_": "http_agent", "query_": "http_query"}
STAMP = "%Y_%m_%d_%H_%M"


def configured(registry: DataFrame, branch: str, model_id: int) -> Row:
    """The branch of one model's configuration."""
    row = run_config(registry, branch, model_id).first()
    if row is None:
        raise LookupError(f"no model {model_id}")
    return row


def window_of(spark: SparkSession, now: datetime.datetime, config: Row, zone_hours: int = 9) -> tuple[str, str]:
    """Start and end of the window a run started at ``now`` looks at."""
    one = spark.createDataFrame([(now, config.now_delta, config.prev_delta)], "now timestamp_ntz, back string, span string")
    out = run_window(one, "now", "back", "span", zone_hours).select(*[F.col(c).cast("string") for c in ("logtime_s", "logtime_e")])
    return tuple(out.first())


def train(
    spark: SparkSession, registry: DataFrame, model_id: int, now: datetime.datetime, log: DataFrame, assets: DataFrame, root: str, depth: int = 5
) -> str:
    """Fits the model's version of the minute ``now`` and returns it.

    The window comes from ``now_delta`` and ``prev_delta``, ``data_limit`` caps each class,
    ``vector_size`` each vocabulary, ``n_grams_lower`` and ``n_grams_upper`` the terms.
    """
    config, version = configured(registry, "train", model_id), now.strftime(STAMP)
    tables, run = RunTables(spark, f"{root}/tables"), f"train-{model_id}-{version}"
    if tables.runs(run):
        return version
    start, end = window_of(spark, now, config)
    rows = training_rows(log, assets, start, end, config.data_limit).renamed(TEXT_COLUMNS)
    rows = rows.with_measures(lambda m: with_split(m, ["label", *KEYS])).stored("training")
    parts = {s: rows.with_measures(lambda m, s=s: m.where(F.col("split") == s)) for s in ("train", "test")}
    caps = {c: config.vector_size for c in TEXT_COLUMNS.values()}
    models = fit_bundle(parts["train"], version, STATUS_COLUMNS, caps, depth, config.n_grams_lower, config.n_grams_upper)
    models.save(spark, f"{root}/models/{model_id}")
    metrics = stored(epoch_metrics(models, spark, model_id, start), "metrics")
    routed = route(models.prepare(parts["test"]), models.tree, models.labels)
    scores = one_vs_rest(routed.select(display_name(F.col("label")).alias("y"), display_name(F.col("route")).alias("p")), "y", "p")
    names = models.features.names
    tables.commit(
        run,
        {
            "tree_nodes": stamped_nodes(node_table(models.tree, names, models.labels, spark), model_id, start, version),
            "importance": importance_table(models.tree, names, model_id, start, spark),
            "metrics": metrics,
            "history": training_history(metrics, scores),
        },
        {"version": version, "start": start, "end": end},
    )
    return version


def newest_version(tables: RunTables, model_id: int, now: datetime.datetime) -> str:
    """The newest version a training run has committed up to ``now``."""
    prefix = f"train-{model_id}-"
    made = [run.removeprefix(prefix) for run in tables.runs(prefix)]
    fit = [v for v in made if v <= now.strftime(STAMP)]
    if not fit:
        raise LookupError(f"model {model_id} has no version up to {now}")
    return max(fit)


def predict(spark: SparkSession, registry: DataFrame, model_id: int, now: datetime.datetime, log: DataFrame, root: str) -> str:
    """Scores the window of ``now`` with the newest version and returns the run's name."""
    config = configured(registry, "predict", model_id)
    tables = RunTables(spark, f"{root}/tables")
    version = newest_version(tables, model_id, now)
    start, end = window_of(spark, now, config)
    run = f"predict-{model_id}-{now.strftime('%Y%m%d%H%M%S')}-{version}"
    if tables.runs(run):
        return run
    models = ModelBundle.load(spark, f"{root}/models/{model_id}", version)
    rows = prediction_rows(log, start, end, limit=config.data_limit).renamed(TEXT_COLUMNS).stored("window")
    scored = stored(models.score(rows).drop("features"), "scored")
    named = mark_anomalies(final_labels(scored, models.labels, None, model_id), models.threshold)
    results = stored(result_rows(named, model_id, version), "results")
    tables.commit(
        run,
        {
            "result": results,
            "result_text": as_text_copy(results),
            "evidence": evidence_rows(named, models.features, model_id, version),
            "explanation": explanation_rows(scored, models, model_id),
        },
        {"version": version, "start": start, "end": end},
    )
    return run
