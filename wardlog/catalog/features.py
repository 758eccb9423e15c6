"""Text features, scaling, rarity and payload texts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardlog.catalog.registry import HAS_TEXT, clean_sql, query
from wardlog.constants import SQL_KEYWORDS, STOP_WORDS, VOCABULARY_CAPS
from wardlog.functions.text import n_grams, words
from wardlog.functions.vectors import pad
from wardlog.ml.corpus import keyword_subsets, payload_texts
from wardlog.ml.likeness import unlike
from wardlog.ml.models import binary_set, fit_anomaly, projection
from wardlog.ml.rarity import (
    grouped_text_rarity,
    grouped_value_share,
    merged_counts,
    text_rarity,
    token_counts,
    value_rarity,
)
from wardlog.ml.scaling import box_threshold, mad_threshold, min_max
from wardlog.ml.slots import fit_slots, sparse
from wardlog.ml.textvec import fit_features, term_weights, vocabulary
from wardlog.operators.ordering import union_all
from wardlog.operators.profiles import Texts, profile
from wardlog.plans.extraction import prediction_rows
from wardlog.plans.feedback import unlike_feedback

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(c: str) -> str:
    found = f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"list_filter({found}, lambda w: w NOT IN ({STOPS}))"


@query(
    "m01_words",
    f"""SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS words
        FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)""",
)
def m01(d):
    rows = d.documents.select("doc_id", words(F.col("text")).alias("w"))
    return rows.select(
        "doc_id", F.size("w").cast("bigint").alias("n"), F.array_join("w", " ").alias("words")
    )


GRAMS = f"""(SELECT conv_id, turn, list_concat(list_concat(w,
    list_transform(w[2:], lambda x, i: concat(w[i], ' ', x))),
    list_transform(w[3:], lambda x, i: concat(w[i], ' ', w[i + 1], ' ', x))) AS g
    FROM (SELECT conv_id, turn, {tokens_sql('text')} AS w FROM conversations))"""


@query(
    "m02_n_grams",
    f"SELECT conv_id, turn, len(g) AS n, array_to_string(g, '|') AS grams FROM {GRAMS}",
)
def m02(d):
    rows = d.conversations.select(
        "conv_id", "turn", n_grams(words(F.col("text")), 1, 3).alias("g")
    )
    return rows.select(
        "conv_id", "turn", F.size("g").cast("bigint").alias("n"),
        F.array_join("g", "|").alias("grams"),
    )


VOCAB = f"""(SELECT term, sum(n) AS cnt, count(*) AS docs FROM (
    SELECT t, term, count(*) AS n FROM (
      SELECT text AS t, unnest({tokens_sql('text')}) AS term FROM (SELECT DISTINCT text FROM documents))
    GROUP BY 1, 2) GROUP BY 1 ORDER BY cnt DESC, term LIMIT 250)"""


@query(
    "m03_vocabulary",
    f"SELECT term, CAST(cnt AS BIGINT) AS cnt, docs FROM {VOCAB}",
)
def m03(d):
    return vocabulary(d.documents, "text", 250)


def capped_vocabulary_sql(column: str, cap: int) -> str:
    return f"""SELECT '{column}' AS "column", term, count(*) AS cnt, count(DISTINCT t) AS docs FROM (
        SELECT t, unnest({tokens_sql('t')}) AS term FROM (SELECT DISTINCT {column} AS t FROM http_log))
        GROUP BY term ORDER BY cnt DESC, term LIMIT {cap}"""


@query(
    "m03_capped_vocabularies",
    " UNION ALL ".join(f"(SELECT * FROM ({capped_vocabulary_sql(c, n)}))"
                       for c, n in VOCABULARY_CAPS.items()),
)
def m03_capped(d):
    log = d.http_log
    return union_all(
        [
            vocabulary(log, c, n).select(F.lit(c).alias("column"), "term", "cnt", "docs")
            for c, n in VOCABULARY_CAPS.items()
        ]
    )


@query(
    "m04_term_weights",
    f"""WITH v AS {VOCAB}, n AS (SELECT count(DISTINCT text) AS n FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (
               SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY 1, 2),
        raw AS (SELECT tf.doc_id, tf.term, tf.tf,
                tf.tf * (ln((1 + (SELECT n FROM n)) / (1 + v.docs)) + 1) AS w FROM tf JOIN v USING (term))
        SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight
        FROM raw""",
)
def m04(d):
    vocab = vocabulary(d.documents, "text", 250)
    out = term_weights(d.documents, "doc_id", "text", vocab)
    return out.withColumn("weight", F.round("weight", 9))


def weights_sql(rows: str, keys: str, column: str, cap: int) -> str:
    """Rows (keys, feature, weight) of one text column, weighted as the vectors are."""
    return f"""(WITH r AS (SELECT {keys}, {column} AS t FROM {rows}),
        d AS (SELECT DISTINCT t FROM r),
        v AS (SELECT term, count(DISTINCT t) AS docs, count(*) AS cnt FROM (
              SELECT t, unnest({tokens_sql('t')}) AS term FROM d)
              GROUP BY 1 ORDER BY cnt DESC, term LIMIT {cap}),
        tf AS (SELECT {keys}, term, count(*) AS tf FROM (
               SELECT {keys}, unnest({tokens_sql('t')}) AS term FROM r) GROUP BY ALL),
        w AS (SELECT {keys}, tf.term, tf.tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + v.docs)) + 1) AS w
              FROM tf JOIN v ON v.term = tf.term)
        SELECT {keys}, concat('{column}_', term) AS feature,
               round(w / sqrt(sum(w * w) OVER (PARTITION BY {keys})), 9) AS weight FROM w)"""


def named_weights(df, model, keys):
    """The vectors' entries other than 0, as rows with the feature's name."""
    names = F.split(F.lit("\n".join(model.names)), "\n")
    pairs = F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("weight"))
    rows = df.select(*keys, F.explode(pairs).alias("p"))
    rows = rows.select(*keys, "p.feature", F.round("p.weight", 9).alias("weight"))
    return rows.where(F.col("weight") != 0)


@query(
    "m05_text_vectors",
    f"""SELECT event_id, 'dst_port' AS feature, CAST(dst_port AS DOUBLE) AS weight FROM http_log
        UNION ALL SELECT * FROM {weights_sql('http_log', 'event_id', 'http_agent', 64)}
        UNION ALL SELECT * FROM {weights_sql('http_log', 'event_id', 'http_query', 64)}""",
)
def m05(d):
    rows = d.http_log.select("event_id", "dst_port", "http_agent", "http_query")
    model = fit_features(rows, ["dst_port"], ["http_agent", "http_query"], 64)
    return named_weights(model.transform(rows), model, ["event_id"])


SLOT_ROWS = """(SELECT logtime, src_ip, count(*) AS cnt,
    lower(array_to_string(list_sort(list(DISTINCT http_query)), ' ')) AS queries,
    lower(array_to_string(list_sort(list(DISTINCT http_host)), ' ')) AS hosts
    FROM http_log GROUP BY 1, 2)"""


@query(
    "m06_array_slots",
    f"""SELECT logtime, src_ip, 'cnt' AS feature, CAST(cnt AS DOUBLE) AS weight FROM {SLOT_ROWS}
        UNION ALL SELECT * FROM {weights_sql(SLOT_ROWS, 'logtime, src_ip', 'queries', 32)}
        UNION ALL SELECT * FROM {weights_sql(SLOT_ROWS, 'logtime, src_ip', 'hosts', 32)}""",
)
def m06(d):
    sets = {"queries": Texts(F.col("http_query")), "hosts": Texts(F.col("http_host"))}
    rows = profile(d.http_log, ["logtime", "src_ip"], sets, whole={"cnt": F.count(F.lit(1))}).stored()
    return sparse_weights(rows, fit_slots(rows, ["cnt"], {c: 32 for c in sets}))


def sparse_weights(profiles, slots):
    """Entries of the sparse vectors as rows with the feature's name."""
    names = F.split(F.lit("\n".join(slots.names)), "\n")
    pairs = F.arrays_zip("places", "weights")
    rows = slots.transform(profiles).select(*profiles.keys, F.explode(pairs).alias("p"))
    weight = F.round("p.weights", 9).alias("weight")
    return rows.select(*profiles.keys, F.get(names, F.col("p.places")).alias("feature"), weight)


PROFILE_TEXTS = f"""(SELECT logtime, src_ip, dst_ip,
    array_to_string(list_sort(list(DISTINCT {clean_sql('http_agent')})), ' ') AS agent_,
    array_to_string(list_sort(list(DISTINCT {clean_sql('http_query')})), ' ') AS query_
    FROM http_log WHERE {HAS_TEXT} GROUP BY 1, 2, 3)"""


@query(
    "m05_profile_features",
    f"""SELECT logtime, src_ip, dst_ip, 'dst_port_cnt' AS feature, CAST(count(DISTINCT dst_port) AS DOUBLE) AS weight
        FROM http_log WHERE {HAS_TEXT} GROUP BY 1, 2, 3
        UNION ALL SELECT * FROM {weights_sql(PROFILE_TEXTS, 'logtime, src_ip, dst_ip', 'agent_', 250)}
        UNION ALL SELECT * FROM {weights_sql(PROFILE_TEXTS, 'logtime, src_ip, dst_ip', 'query_', 2500)}""",
)
def m05_profile(d):
    """Sparse features of the prediction profiles under the vocabulary caps."""
    caps = {"agent_": VOCABULARY_CAPS["http_agent"], "query_": VOCABULARY_CAPS["http_query"]}
    rows = prediction_rows(d.http_log, "2000-01-01 00:00:00", "2100-01-01 00:00:00", once=True).stored()
    return sparse_weights(rows, fit_slots(rows, ["dst_port_cnt"], caps))


@query(
    "m07_padded_slots",
    """SELECT vec_id, len(embedding) + 16 AS size, round(list_sum(list_transform(embedding,
              lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings""",
)
def m07(d):
    padded = pad(F.col("embedding").cast("array<double>"), 80)
    rows = d.embeddings.select("vec_id", padded.alias("p"))
    return rows.select(
        "vec_id", F.size("p").cast("bigint").alias("size"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


SLOT_SIZE = 40


@query(
    "m07_padded_text_slots",
    f"""WITH w AS (SELECT * FROM {weights_sql(SLOT_ROWS, 'logtime, src_ip', 'queries', 32)})
        SELECT r.logtime, r.src_ip, {SLOT_SIZE} AS size, CAST(count(w.weight) AS BIGINT) AS used,
               round(coalesce(sum(w.weight), 0), 6) AS total, round(coalesce(max(w.weight), 0), 6) AS highest
        FROM {SLOT_ROWS} r LEFT JOIN w ON w.logtime = r.logtime AND w.src_ip = r.src_ip GROUP BY 1, 2""",
)
def m07_texts(d):
    """A text column's weights in a slot of fixed size, zeros behind them."""
    sets = {"queries": Texts(F.col("http_query"))}
    rows = profile(d.http_log, ["logtime", "src_ip"], sets).stored()
    slots = fit_slots(rows, [], {"queries": 32})
    out = slots.transform(rows).select("logtime", "src_ip", slots.padded("queries", SLOT_SIZE).alias("slot"))
    total = F.aggregate("slot", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "logtime", "src_ip", F.size("slot").alias("size"), F.size(F.filter("slot", lambda x: x != 0)).cast("bigint").alias("used"),
        F.round(total, 6).alias("total"), F.round(F.array_max("slot"), 6).alias("highest"),
    )


# Alternate sources, so that feedback and samples are profiles of different keys.
FEEDBACK_TEXTS = weights_sql(SLOT_ROWS, "logtime, src_ip", "queries", 32)


@query(
    "m08_unlike_feedback_texts",
    f"""WITH w AS (SELECT * FROM {FEEDBACK_TEXTS}),
        k AS (SELECT DISTINCT logtime, src_ip, hour(logtime) % 6 = 0 AS verdict FROM {SLOT_ROWS}),
        like_one AS (SELECT DISTINCT s.logtime, s.src_ip FROM w s JOIN w v ON v.feature = s.feature
                     WHERE hour(s.logtime) % 6 <> 0 AND hour(v.logtime) % 6 = 0
                     GROUP BY s.logtime, s.src_ip, v.logtime, v.src_ip HAVING round(sum(s.weight * v.weight), 6) >= 0.8)
        SELECT logtime, src_ip FROM k WHERE NOT verdict AND (logtime, src_ip) NOT IN (SELECT (logtime, src_ip) FROM like_one)""",
)
def m08_texts(d):
    """Keys whose queries are unlike those of all keys of every sixth hour, by cosine of their text slots."""
    rows = profile(d.http_log, ["logtime", "src_ip"], {"queries": Texts(F.col("http_query"))}).stored()
    slots = fit_slots(rows, [], {"queries": 32}).transform(rows)
    sixth = F.hour("logtime") % 6 == 0
    return unlike(slots.where(~sixth), slots.where(sixth), 0.8 - 5e-7).select("logtime", "src_ip")


@query(
    "m08_unlike_feedback",
    """SELECT s.vec_id FROM samples s WHERE NOT EXISTS (
         SELECT 1 FROM verdicts v WHERE list_cosine_similarity(
           CAST(s.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) >= 0.35)""",
)
def m08(d):
    return unlike_feedback(d.samples, d.verdicts, "embedding", 0.35).select("vec_id")


SCALED = ["bytes_forward", "bytes_backward", "packets_forward", "fixed"]
SCALED_LOG = "(SELECT *, 7 AS fixed FROM http_log)"


@query(
    "m09_min_max",
    "SELECT event_id, " + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM {SCALED_LOG})) / CAST((SELECT CASE WHEN max({c}) > min({c}) "
        f"THEN max({c}) - min({c}) ELSE 1 END FROM {SCALED_LOG}) AS DOUBLE), 9) AS {c}" for c in SCALED
    ) + f" FROM {SCALED_LOG}",
)
def m09(d):
    rows = d.http_log.withColumn("fixed", F.lit(7)).select("event_id", *SCALED)
    out = min_max(rows, SCALED)
    return out.withColumns({c: F.round(c, 9) for c in SCALED})


@query(
    "m14_binary_sets",
    """SELECT event_id, hash, CAST(hash = 'XSS' AS DOUBLE) AS target,
              CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 AS slot
       FROM http_log WHERE hash IN ('XSS', 'normal')""",
)
def m14(d):
    rows = d.http_log.select("event_id", "hash")
    return binary_set(rows, "XSS", ["event_id"], "hash")


@query(
    "m19_box_threshold",
    """SELECT round(q3 + 26 * (q3 - q1), 6) AS threshold, round(r3 + 26 * (r3 - r1), 6) AS routed FROM (
         SELECT quantile_cont(normal, 0.25) AS q1, quantile_cont(normal, 0.75) AS q3,
                quantile_cont(normal, 0.25) FILTER (WHERE normal > 0) AS r1,
                quantile_cont(normal, 0.75) FILTER (WHERE normal > 0) AS r3 FROM class_scores)""",
)
def m19(d):
    scores = d.class_scores
    whole = box_threshold(scores, "normal")
    routed = box_threshold(scores, "normal", only=F.col("normal") > 0)
    one = scores.agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.lit(round(whole, 6)).alias("threshold"), F.lit(round(routed, 6)).alias("routed"))


@query(
    "m20_mad_threshold",
    """WITH m AS (SELECT median(value) AS m FROM events),
       a AS (SELECT median(abs(value - (SELECT m FROM m))) AS a FROM events)
       SELECT (arg_min(value, (abs(0.6745 * abs(value - (SELECT m FROM m)) / (SELECT a FROM a) - 3.5),
               value))) AS threshold FROM events""",
)
def m20(d):
    return mad_threshold(d.events, "value", 0.6745, 3.5)


TOKENS = r"""(SELECT doc_id, source, unnest(list_filter(string_split_regex(text,
    '[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
    lambda w: w <> '')) AS token FROM {t})"""
TRAIN = "(SELECT * FROM documents WHERE lang <> 'de')"


def tokens_of(table: str) -> str:
    return TOKENS.replace("{t}", table)


@query(
    "m27_token_counts",
    f"""SELECT 'text' AS "column", token, count(*) AS cnt FROM {tokens_of('documents')} GROUP BY 2
        UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR), count(*) FROM documents GROUP BY 2""",
)
def m27(d):
    return token_counts(d.documents, ["text"], ["n_chars"])


@query(
    "m27_merged_counts",
    f"""SELECT 'text' AS "column", token, CAST(count(*) AS BIGINT) AS cnt
        FROM {tokens_of('documents')} GROUP BY 2""",
)
def m27_merged(d):
    french = F.col("lang") == "fr"
    old = token_counts(d.documents.where(french), ["text"])
    return merged_counts(old, token_counts(d.documents.where(~french), ["text"]))


@query(
    "m28_text_rarity",
    f"""WITH c AS (SELECT token, count(*) AS cnt FROM {tokens_of(TRAIN)} GROUP BY 1),
        s AS (SELECT t.doc_id, CASE WHEN count(c.cnt) = count(*)
                THEN 1 - sqrt(sum(c.cnt) / CAST(count(*) AS DOUBLE) / (SELECT sum(cnt) FROM c))
                ELSE 0 END AS score
              FROM {tokens_of('documents')} t LEFT JOIN c USING (token) GROUP BY 1)
        SELECT d.doc_id, round(coalesce(s.score, 0), 9) AS score FROM documents d LEFT JOIN s USING (doc_id)""",
)
def m28(d):
    counts = token_counts(d.documents.where("lang <> 'de'"), ["text"])
    return text_rarity(d.documents, "doc_id", "text", counts).withColumn(
        "score", F.round("score", 9)
    )


@query(
    "m28_value_rarity",
    """WITH c AS (SELECT value, count(*) AS cnt FROM events WHERE event_type <> 'view' GROUP BY 1)
       SELECT e.event_id, round(coalesce(1 - sqrt(c.cnt / CAST((SELECT sum(cnt) FROM c) AS DOUBLE)), 0), 9)
              AS score FROM events e LEFT JOIN c ON c.value = e.value""",
)
def m28_values(d):
    counts = token_counts(d.events.where("event_type <> 'view'"), numbers=["value"])
    return value_rarity(d.events, "event_id", "value", counts).withColumn(
        "score", F.round("score", 9)
    )


@query(
    "m29_grouped_value_share",
    """WITH c AS (SELECT event_type, value, count(*) AS cnt FROM events WHERE event_type <> 'error'
                  GROUP BY 1, 2),
       t AS (SELECT event_type, sum(cnt) AS total FROM c GROUP BY 1),
       a AS (SELECT value, sum(cnt) AS cnt FROM c GROUP BY 1)
       SELECT e.event_id, round(coalesce(CASE WHEN t.total IS NULL
                THEN a.cnt / CAST((SELECT sum(cnt) FROM c) AS DOUBLE)
                ELSE c.cnt / CAST(t.total AS DOUBLE) END, 0), 9) AS score
       FROM events e LEFT JOIN t ON t.event_type = e.event_type
       LEFT JOIN c ON c.event_type = e.event_type AND c.value = e.value
       LEFT JOIN a ON a.value = e.value""",
)
def m29(d):
    known = d.events.where("event_type <> 'error'")
    counts = token_counts(known, numbers=["value"], groups=["event_type"])
    return grouped_value_share(d.events, "event_id", "value", "event_type", counts).withColumn(
        "score", F.round("score", 9)
    )


KNOWN = "(SELECT * FROM documents WHERE source <> 'src3')"


@query(
    "m29_grouped_text_rarity",
    f"""WITH c AS (SELECT source, token, count(*) AS cnt FROM {tokens_of(KNOWN)} GROUP BY 1, 2),
        t AS (SELECT source, sum(cnt) AS total FROM c GROUP BY 1),
        a AS (SELECT token, sum(cnt) AS cnt FROM c GROUP BY 1),
        w AS (SELECT x.doc_id, coalesce(t.total, (SELECT sum(cnt) FROM c)) AS total,
                     CASE WHEN t.total IS NULL THEN a.cnt ELSE c.cnt END AS cnt
              FROM {tokens_of('documents')} x LEFT JOIN t ON t.source = x.source
              LEFT JOIN c ON c.source = x.source AND c.token = x.token
              LEFT JOIN a ON a.token = x.token),
        s AS (SELECT doc_id, CASE WHEN count(cnt) = count(*)
                THEN 1 - sqrt(sum(cnt) / CAST(count(*) AS DOUBLE) / max(total)) ELSE 0 END AS score
              FROM w GROUP BY 1)
        SELECT d.doc_id, round(coalesce(s.score, 0), 9) AS score FROM documents d LEFT JOIN s USING (doc_id)""",
)
def m29_texts(d):
    counts = token_counts(d.documents.where("source <> 'src3'"), ["text"], groups=["source"])
    out = grouped_text_rarity(d.documents, "doc_id", "text", "source", counts)
    return out.withColumn("score", F.round("score", 9))


POOL = "[" + ", ".join(f"'{w}'" for w in SQL_KEYWORDS) + "]"
DRAWN = "CAST('0x' || substr(md5(concat_ws(':', CAST(event_id AS VARCHAR), {x})), 1, 6) AS BIGINT)"


@query(
    "m30_payload_texts",
    f"""SELECT event_id, array_to_string(list_transform(list_sort(list_transform(range(1, s + 1),
          lambda i: {DRAWN.format(x="CAST(i AS VARCHAR)")} % 16)), lambda i: ({POOL})[i + 1]), '') AS payload
        FROM (SELECT event_id, {DRAWN.format(x="'size'")} % 12 + 4 AS s FROM events)""",
)
def m30(d):
    return payload_texts(d.events.select("event_id"), "event_id")


@query(
    "m30_keyword_subsets",
    f"""SELECT event_id, array_to_string(list_transform(list_sort(list_transform({POOL},
          lambda w: {{'r': {DRAWN.format(x="w")}, 'w': w}}))[1:s], lambda x: x.w), ' ') AS subset
        FROM (SELECT event_id, {DRAWN.format(x="'subset'")} % 8 + 1 AS s FROM events)""",
)
def m30_subsets(d):
    return keyword_subsets(d.events.select("event_id"), "event_id")


@query("m31_projection")
def m31(d):
    rows = d.embeddings.withColumns(sparse(F.col("embedding").cast("array<double>")))
    return projection(rows, fit_anomaly(rows, 64, 3)).select("vec_id", "label", "x", "y", "z")


@query(
    "m31_two_columns",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS a,
                  CAST(l_extendedprice AS DOUBLE) / 100000 AS b FROM lineitem),
       s AS (SELECT avg(a) AS ma, avg(b) AS mb, 0.5 * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) AS turn FROM x)
       SELECT l_orderkey, l_linenumber, round(abs(cos(turn) * (a - ma) + sin(turn) * (b - mb)), 6) AS x,
              round(abs(cos(turn) * (b - mb) - sin(turn) * (a - ma)), 6) AS y
       FROM x CROSS JOIN s""",
)
def m31_two(d):
    """Two columns along their own axes, whose angle has a closed form; distances without sign."""
    a, b = F.col("l_quantity").cast("double") / 50, F.col("l_extendedprice").cast("double") / 100000
    rows = d.lineitem.select("l_orderkey", "l_linenumber", F.array(a, b).alias("values"))
    rows = rows.withColumns(sparse(F.col("values")))
    out = projection(rows, fit_anomaly(rows, 2, 2))
    return out.select("l_orderkey", "l_linenumber", *[F.round(F.abs(c), 6).alias(c) for c in "xy"])
