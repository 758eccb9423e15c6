"""Length buckets with the least padding, and batches of a token budget inside each.

The histogram of document lengths covers all documents. Dynamic programming
chooses the bucket limits that minimise padded tokens. Inside a bucket documents
are ranked in hash order and cut into batches of as many as fit into the budget
when padded to the bucket's limit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.ranks import gapless_ranks
from wardlog.session import stored

BUCKETS, BUDGET = 16, 65_536
FINE = 12  # lengths below 2**FINE are exact grid points, longer ones keep 7 leading bits


def word_count(text: str | Column = "text") -> Column:
    """Words of the text and one end token; 1 for an empty or null text."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.coalesce(found, F.lit(0)).cast("bigint") + 1


def grid_length(length: Column) -> Column:
    """The length itself, or above 2**FINE the next number with 7 leading bits.

    So the histogram has some thousand rows whatever the longest document is.
    """
    step = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 6)
    return F.when(length <= 2**FINE, length).otherwise(F.ceil(length / step) * step).cast("bigint")


def best_limits(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket limits (ascending, the last one the largest length) with the least padding.

    The padded size of a bucket is its limit times its documents; this cost satisfies
    the quadrangle inequality, so the best cut moves to the right with the prefix and
    each layer of the program is solved by halving.
    """
    n = len(lengths)
    if n == 0:
        return []
    ahead = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = lengths * ahead[1:]
    cuts = [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        now, cut = best.copy(), np.zeros(n, np.int64)
        todo = [(1, n - 1, 0, n - 2)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            m = (a + b) // 2
            k = np.arange(low, min(high, m - 1) + 1)
            cost = best[k] + lengths[m] * (ahead[m + 1] - ahead[k + 1])
            at = int(np.argmin(cost))
            now[m], cut[m] = cost[at], k[at] + 1
            todo += [(a, m - 1, low, int(k[at])), (m + 1, b, int(k[at]), high)]
        better = now < best
        cut[~better] = -1  # fewer buckets do as well
        best = np.where(better, now, best)
        cuts.append(cut)
    limits, end, layer = [], n - 1, len(cuts) - 1
    while end >= 0:
        while layer and cuts[layer][end] == -1:
            layer -= 1
        limits.append(int(lengths[end]))
        end = int(cuts[layer][end]) - 1 if layer else -1
        layer = max(layer - 1, 0)
    return limits[::-1]


def packed(
    docs: DataFrame,
    tokens: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_limit, batch, place, padding): a row for each row of ``docs``.

    ``bucket`` counts from 0 by length. ``batch`` counts from 0 inside the bucket;
    bucket_limit times the batch's documents is at most ``budget``, and a document
    longer than the budget has a batch of its own: nothing is cut or left out. A null
    or empty text has one token (its end). Null ids and repeated rows are packed like
    others. An empty table gives no rows.
    """
    tokens = word_count() if tokens is None else tokens
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), tokens.cast("bigint").alias("n_tokens"))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    rows = rows.withColumn("_grid", grid_length(F.col("n_tokens")))
    histogram = np.array(rows.groupBy("_grid").count().orderBy("_grid").collect(), np.int64).reshape(-1, 2)
    limits = best_limits(histogram[:, 0], histogram[:, 1], buckets)
    edges = F.array(*map(F.lit, limits)) if limits else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("_grid"))))
    ranked = gapless_ranks(rows, "bucket", F.xxhash64(F.lit(11), "doc_id", "n_tokens", "_row"))
    limit = F.element_at(edges, F.col("bucket") + 1).cast("bigint")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / limit)).cast("bigint")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        limit.alias("bucket_limit"),
        F.floor(F.col("rank") / fit).cast("bigint").alias("batch"),
        (F.col("rank") % fit).alias("place"),
        (limit - F.col("n_tokens")).alias("padding"),
    )
