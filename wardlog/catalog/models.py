"""Fitted models: checked by their own properties, as fits are not SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.catalog.registry import HAS_TEXT, query
from wardlog.constants import VOCABULARY_CAPS
from wardlog.functions.vectors import display_name
from wardlog.ml.metrics import one_vs_rest
from wardlog.ml.models import (
    ModelBundle,
    epoch_metrics,
    fit_anomaly,
    fit_bundle,
    fit_specialist,
    reconstruction_error,
)
from wardlog.ml.scoring import (
    STATUS_COLUMNS,
    as_text_copy,
    evidence_rows,
    explanation_rows,
    final_labels,
    mark_anomalies,
    result_rows,
)
from wardlog.ml.slots import as_vectors, sparse
from wardlog.ml.tree import fit_tree, importance_table, node_table, route, stamped_nodes
from wardlog.operators.ordering import with_split
from wardlog.operators.profiles import Profiles
from wardlog.plans.extraction import KEYS, prediction_rows, training_rows
from wardlog.session import scratch

MODEL_ID = 334
VERSION = "2024_02_01_00_00"
START, END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
NAMES = {"agent_": "http_agent", "query_": "http_query"}
CAPS = {c: VOCABULARY_CAPS[c] for c in NAMES.values()}
_fitted: dict[tuple, ModelBundle] = {}


def extracted(d) -> Profiles:
    rows = training_rows(d.http_log, d.ip_ast, START, END, once=True).renamed(NAMES)
    return rows.with_measures(lambda m: with_split(m, ["label", *KEYS]))


def part_of(profiles: Profiles, split: str) -> Profiles:
    return profiles.with_measures(lambda m: m.where(F.col("split") == split))


def bundle(d) -> ModelBundle:
    """The models of a folder, fitted once per session."""
    key = (d.spark.sparkContext.applicationId, d.folder)
    if key not in _fitted:
        _fitted[key] = fit_bundle(part_of(extracted(d), "train"), VERSION, STATUS_COLUMNS, CAPS)
    return _fitted[key]


def window_rows(d) -> Profiles:
    return prediction_rows(d.http_log, START, END, once=True).renamed(NAMES)


def labelled_results(d, scored: DataFrame) -> DataFrame:
    b = bundle(d)
    named = final_labels(scored, b.labels, None, MODEL_ID)
    return mark_anomalies(named, b.threshold)


@query("s11_saved_models")
def s11(d):
    root = scratch(d.spark, "models")
    bundle(d).save(d.spark, root)
    again = ModelBundle.load(d.spark, root, VERSION)
    return again.score(window_rows(d)).select(*KEYS, "route", *again.labels)


@query("m10_tree_routes")
def m10(d):
    b = bundle(d)
    test = part_of(extracted(d), "test")
    return route(b.prepare(test), b.tree, b.labels).select("label", *KEYS, "route")


@query("m11_tree_nodes")
def m11(d):
    b = bundle(d)
    nodes = node_table(b.tree, b.features.names, b.labels, d.spark)
    return stamped_nodes(nodes, MODEL_ID, START, VERSION)


@query("m12_tree_parents")
def m12(d):
    b = bundle(d)
    return node_table(b.tree, b.features.names, b.labels, d.spark).select("node_num", "node_from")


@query("m13_feature_importance")
def m13(d):
    b = bundle(d)
    return importance_table(b.tree, b.features.names, MODEL_ID, START, d.spark)


@query("m15_specialist_scores")
def m15(d):
    b = bundle(d)
    attacks = [c for c in b.labels if c != "normal"]
    return b.score(window_rows(d)).select(*KEYS, "route", *attacks)


@query("m15_training_metrics")
def m15_metrics(d):
    return epoch_metrics(bundle(d), d.spark, MODEL_ID, START)


@query("m16_tree_scores")
def m16_tree(d):
    b = bundle(d)
    test = part_of(extracted(d), "test")
    routed = route(b.prepare(test), b.tree, b.labels)
    return one_vs_rest(
        routed.select(display_name(F.col("label")).alias("y"), display_name(F.col("route")).alias("p")),
        "y", "p",
    )


@query("m17_reconstruction_errors")
def m17(d):
    b = bundle(d)
    out = reconstruction_error(b.prepare(window_rows(d)), b.anomaly)
    return out.select(*KEYS, "recon_error")


@query(
    "m17_two_columns",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS a,
                  CAST(l_extendedprice AS DOUBLE) / 100000 AS b FROM lineitem),
       s AS (SELECT avg(a) AS ma, avg(b) AS mb, 0.5 * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) AS turn FROM x)
       SELECT l_orderkey, l_linenumber,
              round(power(cos(turn) * (b - mb) - sin(turn) * (a - ma), 2) / 2, 6) AS recon_error
       FROM x CROSS JOIN s""",
)
def m17_two(d):
    """Two columns: what is left of a row beside the longer axis, whose angle has a closed form."""
    a, b = F.col("l_quantity").cast("double") / 50, F.col("l_extendedprice").cast("double") / 100000
    rows = d.lineitem.select("l_orderkey", "l_linenumber", F.array(a, b).alias("values"))
    rows = rows.withColumns(sparse(F.col("values")))
    out = reconstruction_error(rows, fit_anomaly(rows, 2, 1))
    return out.select("l_orderkey", "l_linenumber", F.round("recon_error", 6).alias("recon_error"))


@query("m24_scored_results")
def m24_scored(d):
    scored = bundle(d).score(window_rows(d))
    return as_text_copy(result_rows(labelled_results(d, scored), MODEL_ID, VERSION))


@query("m25_explanations")
def m25_rows(d):
    b = bundle(d)
    return explanation_rows(b.score(window_rows(d)), b, MODEL_ID)


@query("m26_evidence")
def m26(d):
    b = bundle(d)
    return evidence_rows(labelled_results(d, b.score(window_rows(d))), b.features, MODEL_ID, VERSION)


FEATURES = ["l_quantity", "l_discount", "l_tax"]
CLASSES = ["A", "N", "R"]
SPLIT_ROWS = "(SELECT l_returnflag AS label, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(FEATURES)
) + " FROM lineitem)"


def split_sql(rows: str) -> str:
    """(feature, threshold, lost) of the best gini split, counted out over all values; lost is the impurity it takes away."""
    long = " UNION ALL ".join(f"SELECT {i} AS feature, f{i} AS v, label FROM {rows}" for i in range(len(FEATURES)))
    counts = ", ".join(f"count(*) FILTER (WHERE label = '{c}') AS n{i}" for i, c in enumerate(CLASSES))
    k = range(len(CLASSES))
    left = ", ".join(f"CAST(sum(n{i}) OVER (PARTITION BY feature ORDER BY v) AS DOUBLE) AS l{i}" for i in k)
    whole = ", ".join(f"CAST(sum(n{i}) OVER (PARTITION BY feature) AS DOUBLE) AS t{i}" for i in k)

    def spread(sides: list[str]) -> str:
        n = f"({' + '.join(sides)})"
        return f"({n} - ({' + '.join(f'{s} * {s}' for s in sides)}) / {n})"

    parts = f"{spread([f'l{i}' for i in k])} + {spread([f'(t{i} - l{i})' for i in k])}"
    return f"""(SELECT feature, (v + high) / 2 AS threshold, {spread([f't{i}' for i in k])} - ({parts}) AS lost FROM (
        SELECT feature, v, lead(v) OVER (PARTITION BY feature ORDER BY v) AS high, {left}, {whole} FROM (
          SELECT feature, v, {counts} FROM ({long}) GROUP BY 1, 2)) WHERE high IS NOT NULL
        ORDER BY round({parts}, 9), feature, v LIMIT 1)"""


PICKED = "CASE s.feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END"
EXACT_TREE = f"""x AS {SPLIT_ROWS}, s0 AS {split_sql('x')},
    xl AS (SELECT x.* FROM x, s0 s WHERE {PICKED} <= s.threshold), xr AS (SELECT x.* FROM x, s0 s WHERE {PICKED} > s.threshold),
    s1 AS {split_sql('xl')}, s4 AS {split_sql('xr')},
    leaves AS (SELECT label, CASE WHEN {PICKED} <= s.threshold THEN 2 ELSE 3 END AS leaf FROM xl, s1 s
               UNION ALL SELECT label, CASE WHEN {PICKED} <= s.threshold THEN 5 ELSE 6 END FROM xr, s4 s),
    named AS (SELECT leaf, label AS attack_nm FROM (SELECT leaf, label, count(*) AS n FROM leaves GROUP BY 1, 2)
              QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n DESC, label) = 1),
    names AS (SELECT unnest(range({len(FEATURES)})) AS feature, unnest({FEATURES}) AS name)"""


def exact_tree(d):
    columns = F.array(*[F.col(c).cast("double") for c in FEATURES])
    rows = d.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"), columns.alias("values"))
    rows = rows.withColumns(sparse(F.col("values")))
    return rows, fit_tree(rows, CLASSES, 2)


@query(
    "m11_exact_splits",
    f"""WITH {EXACT_TREE}
        SELECT '-' AS attack_nm, round(s.threshold, 6) AS value, name AS features, n AS node_num, node_from, l AS node_to_left,
               r AS node_to_right, level
        FROM (SELECT *, 0 AS n, '-' AS node_from, '1' AS l, '4' AS r, 0 AS level FROM s0
              UNION ALL SELECT *, 1, '0', '2', '3', 1 FROM s1 UNION ALL SELECT *, 4, '0', '5', '6', 1 FROM s4) s
        JOIN names USING (feature)
        UNION ALL SELECT attack_nm, NULL, '-', leaf, CASE WHEN leaf < 4 THEN '1' ELSE '4' END, '-', '-', 2 FROM named""",
)
def m11_exact(d):
    """Node table of a tree of two levels over three columns."""
    _, tree = exact_tree(d)
    nodes = node_table(tree, FEATURES, CLASSES, d.spark)
    return nodes.withColumns({"value": F.round(F.expr("try_cast(value AS double)"), 6), "node_num": F.col("node_num").cast("int")})


@query(
    "m10_exact_routes",
    f"""WITH {EXACT_TREE} SELECT l.label, n.attack_nm AS route, count(*) AS n FROM leaves l JOIN named n USING (leaf) GROUP BY 1, 2""",
)
def m10_exact(d):
    """How many rows of each class the tree sends to each class."""
    rows, tree = exact_tree(d)
    return route(rows, tree, CLASSES).groupBy("label", "route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m12_exact_parents",
    f"""WITH {EXACT_TREE} SELECT n AS node_num, p AS node_from, CAST(rows AS BIGINT) AS below FROM (
          SELECT 1 AS n, 0 AS p, (SELECT count(*) FROM xl) AS rows UNION ALL SELECT 4, 0, (SELECT count(*) FROM xr)
          UNION ALL SELECT leaf, CASE WHEN leaf < 4 THEN 1 ELSE 4 END, count(*) FROM leaves GROUP BY 1)""",
)
def m12_exact(d):
    """Parent of each node, and how many rows reach the node."""
    _, tree = exact_tree(d)
    found = [(number, parent, node.rows) for number, parent, _, node in tree.numbered() if parent is not None]
    return d.spark.createDataFrame(found, "node_num int, node_from int, below bigint")


@query(
    "m13_exact_importance",
    f"""WITH {EXACT_TREE}, lost AS (SELECT feature, lost FROM s0 UNION ALL SELECT feature, lost FROM s1
          UNION ALL SELECT feature, lost FROM s4)
        SELECT name AS feature, round(coalesce(sum(lost), 0) / (SELECT sum(lost) FROM lost), 6) AS value
        FROM names LEFT JOIN lost USING (feature) GROUP BY name""",
)
def m13_exact(d):
    """The share of the impurity taken away by the splits of each column."""
    _, tree = exact_tree(d)
    table = importance_table(tree, FEATURES, MODEL_ID, START, d.spark)
    return table.select("feature", F.round("value", 6).alias("value"))


@query(
    "m15_log_odds",
    """WITH c AS (SELECT http_method = 'GET' AS get, count(*) FILTER (WHERE hash = 'XSS') / CAST(count(*) FILTER (WHERE hash = 'normal') AS DOUBLE) AS odds
                  FROM http_log WHERE hash IN ('XSS', 'normal') GROUP BY 1)
       SELECT round((SELECT ln(odds) FROM c WHERE NOT get), 4) AS intercept,
              round((SELECT ln(odds) FROM c WHERE get) - (SELECT ln(odds) FROM c WHERE NOT get), 4) AS weight""",
)
def m15_odds(d):
    """A specialist over one column of 0 and 1, without a penalty: the log odds have a closed form."""
    get = F.when(F.col("http_method") == "GET", 1.0).otherwise(0.0)
    rows = d.http_log.select(F.when(F.col("hash") == "XSS", "XSS").when(F.col("hash") == "normal", "normal").alias("label"), F.array(get).alias("values"))
    rows = as_vectors(rows.where(F.col("label").isNotNull()).withColumns(sparse(F.col("values"))), 1)
    model = fit_specialist(rows, "XSS", 200, 0.0, 1e-12)
    found = [(round(model.intercept, 4), round(model.weights[0], 4))]
    return d.spark.createDataFrame(found, "intercept double, weight double")


WINDOW_KEYS = f"(SELECT DISTINCT logtime, src_ip, dst_ip FROM http_log WHERE {HAS_TEXT} AND logtime BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}')"


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys there are and how many of them differ between two tables of the same columns."""
    rest = [c for c in a.columns if c not in keys]
    left = a.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*rest).alias("_l"))
    right = b.select(*keys, F.struct(*rest).alias("_r"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = left.join(right, same, "full_outer")
    return both.agg(F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("mismatches"))


@query("s11_saved_models_agree", f"SELECT count(*) AS keys, CAST(0 AS BIGINT) AS mismatches FROM {WINDOW_KEYS}")
def s11_agree(d):
    """Scores of the models as fitted and as read back."""
    root = scratch(d.spark, "models")
    bundle(d).save(d.spark, root)
    rows = window_rows(d).stored()
    columns = [*KEYS, "route", "recon_error", *bundle(d).labels]
    found = [m.score(rows).select(*columns) for m in (bundle(d), ModelBundle.load(d.spark, root, VERSION))]
    return agreement(*found, KEYS)


@query("m26_evidence_keys", f"SELECT count(*) AS keys, CAST(0 AS BIGINT) AS mismatches FROM {WINDOW_KEYS}")
def m26_keys(d):
    """Evidence there is for the rows that are not normal, and no others, with the values they were scored on."""
    b = bundle(d)
    scored = b.score(window_rows(d))
    named = labelled_results(d, scored)
    proof = evidence_rows(named, b.features, MODEL_ID, VERSION)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.abs(x))
    start = len(b.features.numbers)
    texts = F.filter(F.zip_with("places", "weights", lambda p, w: F.when(p >= start, w)), lambda w: w.isNotNull())
    want = named.select(*KEYS, F.when(F.col("att_name") != "NORMAL", F.round(total(texts), 9)).alias("v"), (F.col("att_name") != "NORMAL").alias("alert"))
    got = proof.select(*KEYS, F.round(total(F.concat("http_agent_value", "http_query_value")), 9).alias("v"), F.lit(True).alias("alert"))
    quiet = named.where("att_name = 'NORMAL'").select(*KEYS, F.lit(None).cast("double").alias("v"), F.lit(False).alias("alert"))
    return agreement(want, got.unionByName(quiet), KEYS)
