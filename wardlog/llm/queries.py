"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.llm import boosting, hard_negatives, katz, minhash, mixing, packing, pieces, pii, quantised, repetition, rollups, sharding, spelling
from wardlog.session import configure, scratch, stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda table: configure(spark).read.parquet(f"{folder}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_setsketch_near_dedup")
def op1(table):
    """Near-duplicate groups of all documents on three-word shingles at 85 percent."""
    return minhash.near_duplicates(table("documents"), shingle=3, percent=85)


@query("op9_boosted_quality")
def op9(table):
    """Quality score of every document, learned from the labelled rows outside the held-out fold."""
    return boosting.quality_scores(table("documents"), table("labels"))


@query("op3_suffix_repetition")
def op3(table):
    """Repetition measures and verdict of every document."""
    return repetition.with_verdict(repetition.repetition(table("documents")).drop("repeats"))


@query("op4_shuffled_shards")
def op4(table):
    """All documents in 24 shards of equal row counts, in random order."""
    rows = table("documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shuffled_shards(rows, shards=24, seed=1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_length_buckets")
def op6(table):
    """Bucket, batch and padding of every document."""
    return packing.packed(table("documents"))


@query("op8_weak_supervision_pii")
def op8(table):
    """Personal data of every document."""
    return pii.personal_data(table("documents"))


@query("op10_product_quantised_near_dedup")
def op10(table):
    """Links and groups of all vectors of a label at cosine 0.93."""
    return quantised.near_vectors(table("embeddings"))


@query("op2_soft_membership_mixing")
def op2(table):
    """Domain likelihoods, rate and copies of every document, for a mostly clean mix."""
    weights = {"clean": 0.9, "low": 0.06, "toxic": 0.04}
    return mixing.mixed(table("documents"), mixing.quality_domains(table("labels")), weights)


@query(
    "op7_token_rollups",
    """
    WITH counted AS (
      SELECT d.source, d.lang, l.gone, len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')) AS words,
             len(regexp_extract_all(d.text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]')) AS pieces
      FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, true AS gone FROM labels WHERE toxic = 1) l USING (doc_id)),
    versions AS (
      SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM counted WHERE gone IS NULL
      UNION ALL SELECT source, lang, 'pieces-1', pieces FROM counted WHERE gone IS NULL)
    SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens
    FROM versions GROUP BY ALL
    """,
)
def op7(table):
    """Token totals after inserts under two tokenizers, a takedown, a revision and a repeated batch."""
    docs = table("documents")
    ledger = rollups.TokenRollup(docs.sparkSession, scratch(docs.sparkSession, "rollup"))
    counts = stored(
        docs.select("doc_id", "source", "lang", "n_chars", rollups.word_tokens().alias("words"), rollups.piece_tokens().alias("pieces")),
        "counts",
    )
    change = lambda kind, tokenizer, n: counts.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(kind).alias("change"), n.alias("n_tokens"))
    # the first count of pieces is by characters and is revised by the third batch
    ledger.commit("1-inserts", change("insert", "words-1", F.col("words")).unionAll(change("insert", "pieces-1", F.col("n_chars"))))
    toxic = table("labels").where("toxic = 1").select("doc_id").distinct()
    takedown = toxic.select(
        "doc_id", *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "tokenizer")), F.lit("delete").alias("change"), F.lit(None).cast("bigint").alias("n_tokens")
    )
    ledger.commit("2-takedown", takedown)
    live = counts.join(toxic, "doc_id", "left_anti")
    revised = live.select("doc_id", "source", "lang", F.lit("pieces-1").alias("tokenizer"), F.lit("revise").alias("change"), F.col("pieces").alias("n_tokens"))
    ledger.commit("3-revision", revised)
    ledger.commit("3-revision", revised)
    return ledger.totals()


@query("op5_katz_backoff")
def op5(table):
    """Scores of all documents by a back-off model of those outside the held-out fold."""
    return katz.katz_scores(table("documents"))


@query("op11_sentencepiece_merge_rounds")
def op11(table):
    """Ids of every document and the text they give, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decoded(pieces.encoded(table("documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op12_hilbert_hard_negatives",
    """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op12(table):
    """Hard negatives of all anchors, labels of every seventh id moved on by one."""
    rows = table("embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


@query("op13_spelling_trie_frontier")
def op13(table):
    """Words of all documents with their near words' count, form and root."""
    return spelling.spelling_variants(table("documents"))
