"""Routing, labels, result rows, scores and explanations given the numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlog.catalog.registry import listed, query
from wardlog.functions.vectors import display_name
from wardlog.ml.metrics import one_vs_rest
from wardlog.ml.models import spread_scores
from wardlog.ml.scoring import explained, final_labels, mark_anomalies, result_rows

LABELS = ["credential", "file_download", "injection", "normal", "xss"]
ATTACKS = [c for c in LABELS if c != "normal"]
THRESHOLD = 0.3

QUIET = " AND ".join(f"{c} <= 0.5" for c in ATTACKS)
CODES = {"CREDENTIAL": 1, "SQL_INJECTION": 2, "XSS": 3, "FILE_DOWNLOAD": 4, "ANOMALY": 5}
CODE_SQL = "CASE att_name " + " ".join(
    f"WHEN '{n}' THEN {33400 + c}" for n, c in CODES.items()
) + " ELSE 33400 END"


def labels_sql(anomaly: str) -> str:
    """Class scores -> name, in the order credential, file_download, injection, normal, xss."""
    return f"""(SELECT *, CAST({CODE_SQL} AS BIGINT) AS result FROM (
        SELECT *, CASE WHEN credential > 0.5 THEN 'CREDENTIAL' WHEN file_download > 0.5 THEN 'FILE_DOWNLOAD'
               WHEN injection > 0.5 THEN 'SQL_INJECTION' WHEN n2 > 0.5 THEN 'NORMAL'
               WHEN xss > 0.5 THEN 'XSS' ELSE 'ANOMALY' END AS att_name,
               greatest(credential, file_download, injection, n2, xss, anomaly) AS max_score
        FROM (SELECT *, CASE WHEN {QUIET} AND anomaly <= 0.5 THEN 1 ELSE normal END AS n2
              FROM (SELECT *, {anomaly} AS anomaly FROM class_scores))))"""


@query(
    "m18_routed_scores",
    "SELECT event_id, " + ", ".join(LABELS) + " FROM class_scores",
)
def m18(d):
    return spread_scores(d.scores, LABELS).select("event_id", *LABELS)


@query(
    "m21_final_labels",
    f"""SELECT event_id, att_name, result, max_score,
               CAST(max_score > 0.5 AS DOUBLE) AS is_hit, normal AS anomaly_score
        FROM {labels_sql('0')}""",
)
def m21(d):
    out = final_labels(d.class_scores, LABELS, None, 334)
    return out.select("event_id", "att_name", "result", "max_score", "is_hit", "anomaly_score")


@query(
    "m21_training_labels",
    f"""SELECT event_id, att_name, result
        FROM {labels_sql(f"CASE WHEN normal > {THRESHOLD} THEN 1 ELSE 0 END")}""",
)
def m21_train(d):
    out = final_labels(d.class_scores, LABELS, THRESHOLD, 334)
    return out.select("event_id", "att_name", "result")


@query(
    "m22_result_codes",
    f"SELECT att_name, result, count(*) AS n FROM {labels_sql('0')} GROUP BY 1, 2",
)
def m22(d):
    out = final_labels(d.class_scores, LABELS, None, 334)
    return out.groupBy("att_name", "result").agg(F.count(F.lit(1)).alias("n"))


MARKED = f"""(SELECT * EXCLUDE (att_name), CASE WHEN normal > {THRESHOLD} THEN 'ANOMALY' ELSE att_name END
    AS att_name, CASE WHEN att_name = 'NORMAL' THEN {THRESHOLD}
    ELSE CAST(max_score > 0.5 AS DOUBLE) END AS probs FROM {labels_sql('0')})"""


@query(
    "m23_marked_anomalies",
    f"SELECT event_id, att_name, result, CAST(probs AS DOUBLE) AS probs FROM {MARKED}",
)
def m23(d):
    out = mark_anomalies(final_labels(d.class_scores, LABELS, None, 334), THRESHOLD)
    return out.select("event_id", "att_name", "result", "probs")


@query(
    "m23_consistent_codes",
    f"""SELECT event_id, att_name, CASE WHEN att_name = 'ANOMALY' THEN 33405 ELSE result END AS result
        FROM {MARKED}""",
)
def m23_consistent(d):
    named = final_labels(d.class_scores, LABELS, None, 334)
    return mark_anomalies(named, THRESHOLD, True).select("event_id", "att_name", "result")


RESULT_ROWS_SQL = (
    f"""SELECT DISTINCT CAST(334 AS BIGINT) AS model_id, date_trunc('hour', ts) AS logtime,
          ts AS "end", '-' AS rule, src_ip, '192.168.1.1' AS dst_ip, '-' AS src_ip_country_code,
          '-' AS dst_ip_country_code, 0 AS ast_ip, 0 AS related_ip, '-' AS direction_inout,
          0 AS direction_inout_bin, '-' AS related_country, att_name, result,
          CAST(probs AS DOUBLE) AS probs, normal AS anomaly_score, '2024_02_01_00_00' AS feedback,
          0 AS packet, 0 AS if_label, 0 AS if_score, 0 AS lof_label, 0 AS lof_score,
          0 AS ai_label, 0 AS ai_score FROM {MARKED}"""
)


@query("m24_result_rows", RESULT_ROWS_SQL)
def m24(d):
    rows = d.class_scores.withColumns(
        {
            "logtime": F.date_trunc("hour", "ts").cast("timestamp_ntz"),
            "end": F.col("ts"),
            "dst_ip": F.lit("192.168.1.1"),
        }
    )
    named = mark_anomalies(final_labels(rows, LABELS, None, 334), THRESHOLD)
    return result_rows(named, 334, "2024_02_01_00_00")


NAME_CASE = """CASE {c} WHEN 'injection' THEN 'SQL_INJECTION' WHEN 'xss' THEN 'XSS'
    WHEN 'file_download' THEN 'FILE_DOWNLOAD' WHEN 'credential' THEN 'CREDENTIAL' ELSE 'NORMAL' END"""


@query(
    "m16_one_vs_rest",
    f"""WITH p AS (SELECT {NAME_CASE.format(c='s.route')} AS y, l.att_name AS p
                   FROM {labels_sql('0')} l JOIN scores s ON s.event_id = l.event_id),
        c AS (SELECT DISTINCT y AS c FROM p),
        m AS (SELECT c.c, count(*) FILTER (WHERE y = c AND p = c) AS tp,
                     count(*) FILTER (WHERE y <> c AND p = c) AS fp,
                     count(*) FILTER (WHERE y = c AND p <> c) AS fn,
                     count(*) FILTER (WHERE y <> c AND p <> c) AS tn FROM c, p GROUP BY 1)
        SELECT c AS attack_name, tp, fp, fn, tn, tp + fp AS train_cnt, tp + fn AS test_cnt,
               (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS accuracy,
               coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall,
               coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision,
               coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f1_score
        FROM m WHERE tp + fp > 0 AND tp + fn > 0 AND c <> 'ANOMALY'""",
)
def m16(d):
    named = final_labels(d.class_scores, LABELS, None, 334).select("event_id", "att_name")
    rows = d.scores.select("event_id", display_name(F.col("route")).alias("y"))
    return one_vs_rest(rows.join(named, "event_id"), "y", "att_name")


# Any weights do for the check: attribution is weight times value.
SHARE = "list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * (i % 5 - 2))"


@query(
    "m25_explained",
    f"""SELECT vec_id,
               array_to_string(list_transform(s, lambda x: CAST(x[2] AS BIGINT)), ',') AS place,
               array_to_string(list_transform(s, lambda x: CAST(round(x[1] * 1000000) AS BIGINT)), ',')
               AS score
        FROM (SELECT vec_id, list_reverse_sort(list_transform(a, lambda v, i: [v - m, CAST(i AS DOUBLE)])) AS s
              FROM (SELECT vec_id, a, list_median(a) AS m
                    FROM (SELECT vec_id, {SHARE} AS a FROM embeddings)))""",
)
def m25(d):
    rows = d.embeddings.withColumn("v", F.col("embedding").cast("array<double>"))
    places = F.sequence(F.lit(1), F.size("v"))
    weights = F.transform(places, lambda i: (i % 5 - 2).cast("double"))
    out = explained(rows, "v", weights, places.cast("array<double>"))
    return listed(out, "vec_id", F.col("feature"), F.col("score"))
