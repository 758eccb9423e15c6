"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. A register is the exponent
(base ``BASE``) of the smallest of exponentially distributed hash values of that
set: registers of a union are the larger ones of its parts (mergeable), and two
sets agree in a register about as often as their similarity (locality-sensitive).

1. Equal sets are folded into one representative, the smallest id.
2. Each of ``BANDS`` keys hashes ``ROWS`` registers; representatives with a common
   key are candidates.
3. Inside a key every candidate is first compared with the key's smallest id: a pair
   is dropped where the joint likelihood of its registers, given both set sizes, puts
   the similarity far (5 standard errors) below the threshold; all others are decided
   on the full sets.
4. Candidates already connected need no comparison among themselves. In keys that
   still hold several components, the candidates outside the largest one are
   compared with all others: in keys of up to ``FEW`` candidates pair by pair as
   above, in larger ones on the full sets in blocks of ``BLOCK`` rows a side; a block
   returns its groups, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

from wardlog.llm.components import components
from wardlog.llm.words import as_bytes, mix, shingle_set, spare, text_slices, words
from wardlog.session import stored

REGISTERS, BANDS, ROWS = 256, 60, 10
BASE, RATE, TOP = 1.2, 20.0, 255
MARGIN, BLOCK, FEW = 0.12, 128, 16


def seeds(n: int, start: int) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64)) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets of 64-bit hashes, one row each."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    values = np.concatenate(sets)
    low = np.empty((len(sets), REGISTERS), np.uint64)
    factors, shifts = seeds(REGISTERS, 1), seeds(REGISTERS, 10_001)
    for first in range(0, len(values), 1 << 14):  # a slice stays in the processor's cache
        last = min(first + (1 << 14), len(values))
        i, j = np.searchsorted(starts, [first, last - 1], "right")
        cuts = np.maximum(starts[i - 1 : j], first) - first
        part = values[first:last]
        for r in range(REGISTERS):
            h = part * factors[r] + shifts[r]
            h ^= h >> np.uint64(32)
            h *= factors[r]
            least = np.minimum.reduceat(h, cuts)
            if starts[i - 1] < first:
                least[0] = min(least[0], low[i - 1, r])
            low[i - 1 : j, r] = least
    u = (low >> np.uint64(11)).astype(np.float64) * 2.0**-53
    x = -np.log1p(-u) / RATE
    k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _below(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the order of two rows of registers most likely."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def value(j):
        p, q = _below(u - v * j), _below(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(c > 0, c * np.log(np.maximum(x, 1e-12)), 0.0) for c, x in ((more, p), (less, q), (same, 1 - p - q))]
        return sum(parts)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def band_places() -> np.ndarray:
    """The registers of each key: every register is used about equally often."""
    rng = np.random.default_rng(7)
    laps = -(-BANDS * ROWS // REGISTERS)
    order = np.concatenate([rng.permutation(REGISTERS) for _ in range(laps)])
    return np.stack([order[i * ROWS : (i + 1) * ROWS] for i in range(BANDS)])


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, regs) of each document; digest and regs are null for an empty set."""
    schema = "id bigint, n bigint, digest binary, regs binary"

    def run(batches):
        import xxhash

        for part in text_slices(batches):
            sets = [shingle_set(words(t), shingle) for t in part["text"].to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(registers(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    part["id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.data) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["id", "n", "digest", "regs"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("id"), as_bytes(text_col)).mapInArrow(run, schema)


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, id): ``BANDS`` rows for each representative."""

    def run(batches):
        places = band_places()
        salt = seeds(BANDS, 50_001)
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
                keys = np.tile(salt, (len(regs), 1))
                for j in range(ROWS):
                    keys = mix(keys * np.uint64(257) + regs[:, places[:, j]])
                ids = np.repeat(batch["id"].to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, "key bigint, id bigint")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the listed documents: sorted hashes as bytes."""

    def run(batches):
        for part in text_slices(batches):
            sets = [shingle_set(words(t), shingle).tobytes() for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(sets, pa.binary())], ["id", "set"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), as_bytes(text_col))
    return texts.join(ids, "id", "left_semi").mapInArrow(run, "id bigint, set binary")


@pandas_udf(DoubleType())
def estimate(ra, rb, na, nb):
    import pandas as pd

    if not len(ra):
        return pd.Series([], dtype="float64")
    a, b = (np.frombuffer(b"".join(r), np.uint8).reshape(-1, REGISTERS) for r in (ra, rb))
    return pd.Series(likely_similarity(a, b, na.to_numpy(float), nb.to_numpy(float)))


@pandas_udf(LongType())
def shared(a, b):
    import pandas as pd

    def both(x, y):
        z = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        z.sort()
        return int((z[1:] == z[:-1]).sum())

    return pd.Series([both(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    pairs = pairs.join(side("b"), "b").join(side("a"), "a")
    pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = pairs.where(estimate("ra", "rb", "na", "nb") >= percent / 100 - MARGIN).select("a", "b", "na", "nb")
    full = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    pairs = pairs.join(full("b"), "b").join(full("a"), "a").withColumn("both", shared("sa", "sb"))
    return pairs.where("100 * both >= {0} * (na + nb - both)".format(percent)).select("a", "b")


def block_links(ids: np.ndarray, sets: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its group) of all ids that have a link among these sets."""
    sizes = np.array([len(s) // 8 for s in sets])
    values = np.frombuffer(b"".join(sets), np.uint64)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = times[column] > 1  # values of one set alone meet nothing
    row, column = row[common], (np.cumsum(times > 1) - 1)[column[common]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        i, j = np.searchsorted(column, [first, first + 8192])
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[i:j], column[i:j] - first] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.int64)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None] - both)
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            break
        label = new
    linked_rows = near.any(1)
    return ids[linked_rows], label[linked_rows]


def remaining(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect candidates of a key which are in different components.

    ``members`` has (key, id, c) with c the component so far. Only ids outside a key's
    largest component meet all others; members of the largest one are not compared
    with each other.
    """
    counts = members.groupBy("key", "c").count()
    shape = counts.groupBy("key").agg(
        F.max_by("c", F.struct("count", "c")).alias("main"), F.max("count").alias("nm"), F.sum("count").alias("n")
    )
    members = stored(members.join(shape, "key"), "open")
    few = members.where(F.col("n") <= FEW)
    left = few.select("key", F.col("id").alias("a"), F.col("c").alias("ca"))
    right = few.select("key", F.col("id").alias("b"), F.col("c").alias("cb"))
    pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    return linked(pairs, reps, sets, percent).unionAll(in_blocks(members.where(F.col("n") > FEW), sets, percent))


def in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for (key, id, c, main, nm, n) rows of large keys, block by block on the full sets."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    rows = members.select(
        "key", "id", (F.col("c") == F.col("main")).alias("large"), blocks(F.col("nm")).alias("nm"), blocks(F.col("n") - F.col("nm")).alias("no")
    )
    own = F.pmod(F.xxhash64("id", "key"), F.when(F.col("large"), F.col("nm")).otherwise(F.col("no"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    of_large = F.transform(upto("no"), lambda j: cell("large", j, F.col("own")))
    of_other = F.concat(
        F.transform(upto("nm"), lambda j: cell("large", F.col("own"), j)),
        F.transform(upto("no"), lambda j: cell("other", F.least(F.col("own"), j), F.greatest(F.col("own"), j))),
    )
    dealt = rows.select("key", "id", F.explode(F.when(F.col("large"), of_large).otherwise(of_other)).alias("cell"))
    dealt = dealt.select("key", "id", "cell.*").join(sets, "id")

    def compare(part):
        import pandas as pd

        part = part.drop_duplicates("id")
        a, b = block_links(part["id"].to_numpy(), part["set"].tolist(), percent)
        return pd.DataFrame({"a": b, "b": a})

    return dealt.groupBy("key", "kind", "x", "y").applyInPandas(compare, "a bigint, b bigint").where("a <> b")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    Documents are linked where 100 * shared >= ``percent`` * union of their shingle
    sets. A text without words (or null) has no shingles and no links. A row with a
    null id is not compared: its component is null and it is kept. Rows with equal
    texts are equal whatever their ids; a repeated row has its first one's result.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    sketched = stored(sketches(docs, shingle, id_col, text_col), "sketches")
    usable = sketched.where("digest is not null and id is not null")
    reps = usable.groupBy("digest").agg(F.min(F.struct("id", "n", "regs")).alias("r"))
    reps = stored(reps.select("digest", "r.*"), "representatives")
    # the smaller of two different sets has i shingles at most shared with i + 1 or more
    fewest = next(i for i in range(1, 1000) if 100 * i >= percent * (i + 1))
    large = reps.where(F.col("n") >= fewest)
    bands = band_keys(large)
    shared_keys = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    hits = stored(bands.join(shared_keys.select("key", "lead"), "key"), "candidates")
    sets = stored(full_sets(docs, hits.select("id").distinct(), shingle, id_col, text_col), "sets")

    first = hits.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(linked(first, large, sets, percent), "links")
    groups = components(links)
    placed = hits.join(groups.withColumnRenamed("node", "id"), "id", "left")
    placed = stored(placed.select("key", "id", F.coalesce("component", "id").alias("c")), "placed")
    split = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    links = links.unionAll(remaining(placed.join(split, "key").select("key", "id", "c"), large, sets, percent))
    groups = components(links).withColumnRenamed("node", "id")

    rows = sketched.select("id", "n", "digest").join(
        reps.select("digest", F.col("id").alias("rep")).join(groups.withColumnRenamed("id", "rep"), "rep", "left"),
        "digest",
        "left",
    )
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.coalesce("component", "rep"))
    component = F.when(F.col("id").isNotNull(), component)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns stay.

    The smallest id of a group stays, and of rows equal in id and text one.
    Rows with a null id stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = near_duplicates(docs, **options)
    name = spare(docs, "gone")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    rows = docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
    named = rows.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col])
    return named.unionByName(rows.where(F.col(id_col).isNull()))
