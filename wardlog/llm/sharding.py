"""A uniform shuffle into shards of exact sizes by a communication matrix.

How many rows of each partition go to each shard is drawn at once from the
multivariate hypergeometric law, which is the law of these counts in a uniform
shuffle. Rows are permuted inside their partition and dealt by those counts,
exchanged, and permuted again inside their shard. Shard sizes are exact before a
row has moved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlog.llm.ranks import gapless_ranks
from wardlog.session import stored


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each partition (first axis) that go to each shard (second axis).

    Row sums are ``counts``, column sums the shard sizes.
    """
    rng = np.random.default_rng(seed)
    left = shard_sizes(sum(counts), shards)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        out[i] = _draw(rng, left, n)
        left = left - out[i]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw, shard by shard."""
    out = np.zeros(len(left), np.int64)
    rest = int(left.sum())
    for j, good in enumerate(left):
        rest -= int(good)
        out[j] = n if rest == 0 else _hypergeometric(rng, int(good), rest, n)
        n -= int(out[j])
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw for totals of any size: beyond numpy's 10**9 by inversion around the mode."""
    if good == 0 or n == 0:
        return 0
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * good / total
    spread = (mean * (bad / total) * (total - n) / (total - 1)) ** 0.5
    low = int(max(0, n - bad, mean - 12 * spread - 12))
    high = int(min(n, good, mean + 12 * spread + 12))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    odds = np.exp(logs - logs.max()).cumsum()
    return low + int(np.searchsorted(odds, rng.random() * odds[-1], "right"))


def shuffled_shards(df: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """``df`` with the columns shard (0 to ``shards`` - 1) and slot (from 0, gapless in a shard).

    Shard sizes differ by one row at most. Every row has its own place, so null
    ids, nulls in other columns and repeated rows are dealt like any others. An
    empty table gives no rows. ``df`` is written once with its partition numbers, so
    a task that runs again deals the same rows the same way. Columns named shard or
    slot are replaced.
    """
    # the row in one column, so that its names cannot clash with those needed here
    rows = df.drop("shard", "slot").select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_row"))
    tagged = stored(rows, "tagged")
    part = F.shiftright("_row", 33)
    counts = {r[0]: r[1] for r in tagged.groupBy(part.alias("p")).count().collect()}  # a row a partition
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    cuts = tagged.sparkSession.createDataFrame(
        [(int(p), [int(c) for c in row.cumsum()]) for p, row in zip(parts, matrix, strict=True)],
        "_part bigint, _cuts array<bigint>",
    )
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(2 * seed + 1), "_row"), "_row")
    dealt = tagged.withColumn("_part", part).withColumn("_at", F.row_number().over(local) - 1)
    dealt = dealt.join(cuts, "_part").withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))))
    dealt = dealt.select("row", "_row", "shard")
    ranked = gapless_ranks(dealt, "shard", F.xxhash64(F.lit(2 * seed + 2), "_row"), "slot")
    return ranked.select("row.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, rows in slot order inside each file."""
    rows = sharded.hint("rebalance", "shard")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
