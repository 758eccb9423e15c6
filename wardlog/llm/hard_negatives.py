"""Hard negatives from blocks of vectors along a Hilbert curve.

Components become whole numbers (``SCALE`` times, rounded down), scores are their inner
products. All rows are sorted by label and by their place on a Hilbert curve through the
space of components, and cut into Parquet blocks of ``BLOCK`` rows of one label. A zone
map keeps the least and the greatest value of each dimension in a block.

An anchor asks for windows of scores: the ``positives`` best rows of its own label, then,
for each of them, the best ``negatives`` rows of other labels with a score between two
shares of the positive's. Interval arithmetic gives the least and greatest score an anchor
can have in a block. A block is read for a window if its interval meets the window and
reaches the score that enough rows are known to reach: those of blocks whose whole
interval lies in the window. So no row of a result is missed; where vectors have no
structure the intervals are wide and most blocks are read.

Anchors meet zone maps (in pages) and blocks in groups of about ``GROUP``, and a block
hands on a window's best rows only; ranks are made of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.session import scratch, stored

SCALE, BITS, BLOCK, GROUP, PAGE = 256, 4, 2_048, 2_048, 1_024
FAR = np.int64(2**62)


def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve, as rows of bytes that sort like them.

    ``places`` has a row a point and whole coordinates of ``bits`` bits. The coordinates
    are turned into the curve's index, bit by bit from the top: where a bit is set the
    lower bits of the first coordinate are flipped, else they are exchanged with the
    coordinate's; a Gray code undone over all bits gives the index.
    """
    x = places.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q = np.int64(1) << bit
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1:], np.int64)
    for bit in range(bits - 1, 0, -1):
        q = np.int64(1) << bit
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
    x ^= t
    planes = [(x >> bit) & 1 for bit in range(bits - 1, -1, -1)]  # the index's bits, a coordinate after another
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def whole_components(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, width, v): one row for each id that has a label and finite components."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~bad
    rows = vectors.where(fine).select(
        F.col(id_col).cast("bigint").alias("id"), F.struct(F.col(label_col).cast("string").alias("label"), F.size(v).alias("width"), whole_components(v, scale).alias("v")).alias("row")
    )
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


def flat(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def in_blocks(rows: DataFrame, block: int, bits: int) -> DataFrame:
    """(part, block, label, width, id, v) along the curve, in Parquet, a folder a ``part``.

    Rows are sorted into ranges of (width, label, place on the curve); a block is a run of
    at most ``block`` rows of one label inside a range, so none needs a count of its label.
    """
    reach = stored(rows.groupBy("width").agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("reach")), "reach")

    def place(batches):
        for batch in batches:
            widths, reach = batch["width"].to_numpy(), batch["reach"].to_numpy(zero_copy_only=False).astype(np.float64)
            keys = np.empty(batch.num_rows, object)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                if not width:
                    keys[at] = b""
                    continue
                x = flat(batch["v"].take(pa.array(at)), width) / np.maximum(reach[at], 1)[:, None]
                for i, key in zip(at, hilbert_keys(np.minimum((x + 1) / 2 * (1 << bits), (1 << bits) - 1), bits), strict=True):
                    keys[i] = key.tobytes()
            columns = [batch[c] for c in ("id", "label", "width", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary())], ["id", "label", "width", "v", "key"])

    keyed = rows.join(reach, "width").select("id", "label", "width", "v", "reach")
    keyed = keyed.mapInArrow(place, "id bigint, label string, width int, v array<bigint>, key binary")
    order = ["width", "label", "key", "id"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part, at = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    name = F.concat_ws(":", "width", part, F.floor(at / block), "label")
    path = scratch(rows.sparkSession, "blocks")
    ordered.select(part.alias("part"), name.alias("block"), "label", "width", "id", "v").write.partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema("block string, label string, width int, id bigint, v array<bigint>, part int").parquet(path)


ZONES = "part int, block string, label string, width int, n bigint, low array<bigint>, high array<bigint>"


def zone_maps(blocks: DataFrame) -> DataFrame:
    """(part, block, label, width, n, low, high): a row a block."""
    whole = pa.list_(pa.int64())

    def bounds(batches):
        for batch in batches:
            _, first, owner = np.unique(np.array(batch["block"].to_pylist(), object), return_index=True, return_inverse=True)
            for k, one in enumerate(first):
                at = pa.array(np.flatnonzero(owner == k))
                x = flat(batch["v"].take(at), batch["width"][one].as_py())
                same = [pa.array([batch[c][one].as_py()], t) for c, t in (("part", pa.int32()), ("block", pa.string()), ("label", pa.string()), ("width", pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array([len(at)], pa.int64()), pa.array([x.min(0)], whole), pa.array([x.max(0)], whole)],
                    ["part", "block", "label", "width", "n", "low", "high"],
                )

    def merge(part):
        import pandas as pd

        one = {c: [part[c].iloc[0]] for c in ("part", "block", "label", "width")}
        low, high = np.stack(part["low"].to_numpy()).min(0), np.stack(part["high"].to_numpy()).max(0)
        return pd.DataFrame({**one, "n": [part["n"].sum()], "low": [low], "high": [high]})

    # a block may come in several batches
    return blocks.select("part", "block", "label", "width", "v").mapInArrow(bounds, ZONES).groupBy("block").applyInPandas(merge, ZONES)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where these hold all sums."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if float(np.abs(anchors).max()) * float(np.abs(rows).max()) * anchors.shape[1] < 2**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (rows) in each block (columns)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def blocks_to_read(least: np.ndarray, most: np.ndarray, n: np.ndarray, allowed: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(read, reach) for one window an anchor: which blocks to read, and a score that ``k`` rows surely reach."""
    sure = allowed & (least >= floor[:, None]) & (most <= ceiling[:, None])
    # blocks that lie in the window, best first, until they hold k rows
    score = np.where(sure, least, -FAR)
    order = np.argsort(-score, axis=1, kind="stable")
    held = np.cumsum(np.where(np.take_along_axis(sure, order, 1), n[order], 0), axis=1)
    enough = held >= k
    at = enough.argmax(1)
    known = np.take_along_axis(np.take_along_axis(score, order, 1), at[:, None], 1)[:, 0]
    reach = np.maximum(floor, np.where(enough.any(1), known, -FAR))
    return allowed & (most >= reach[:, None]) & (least <= ceiling[:, None]), reach


def best_in_window(scores: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> list[np.ndarray]:
    """For each window the places of its ``k`` best rows in ``scores`` (one anchor); ties by place."""
    order = np.argsort(-scores, kind="stable")
    down = -scores[order]
    first = np.searchsorted(down, -ceiling, "left")
    last = np.minimum(np.searchsorted(down, -floor, "right"), first + k)
    return [order[a:b] for a, b in zip(first, last, strict=True)]


def choose(asks: DataFrame, zones: DataFrame, k: int, same_label: bool, page: int) -> DataFrame:
    """(anchor, tag, part, block): the blocks each window reads.

    Each group of anchors meets each page of zone maps once; what its pages know of a
    window's reach is put together afterwards.
    """
    pages = zones.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-zones.count() // page)))).cast("int"))
    groups = asks.select("width", "group").distinct()
    cells = stored(groups.join(pages.select("width", "page").distinct(), "width"), "cells")
    left = asks.join(cells, ["width", "group"])
    right = pages.join(cells, ["width", "page"])
    kinds = {"anchor": pa.int64(), "tag": pa.int32(), "part": pa.int32(), "block": pa.string(), "most": pa.int64(), "reach": pa.int64()}

    def meet(_, ask, zone):
        found: dict[str, list] = {c: [] for c in kinds}
        if ask.num_rows and zone.num_rows:
            ask, zone = ask.combine_chunks(), zone.combine_chunks()
            width = ask["width"][0].as_py()
            low, high = (flat(zone[c].combine_chunks(), width) for c in ("low", "high"))
            n, label = zone["n"].to_numpy(), np.array(zone["label"].to_pylist(), object)
            block, part = np.array(zone["block"].to_pylist(), object), zone["part"].to_numpy()
            for start in range(0, ask.num_rows, 256):
                some = ask.slice(start, 256).combine_chunks()
                owner = np.repeat(np.arange(some.num_rows), pc.list_value_length(some["tags"]).to_numpy())
                tags, floor, ceiling = (some[c].combine_chunks().flatten().to_numpy() for c in ("tags", "floors", "ceilings"))
                least, most = intervals(flat(some["v"].combine_chunks(), width), low, high)
                allowed = (np.array(some["label"].to_pylist(), object)[:, None] == label) == same_label
                read, reach = blocks_to_read(least[owner], most[owner], n, allowed[owner], floor, ceiling, k)
                i, j = np.nonzero(read)
                new = (some["anchor"].to_numpy()[owner[i]], tags[i], part[j], block[j], most[owner[i], j], reach[i])
                for values, more in zip(found.values(), new, strict=True):
                    values.append(more)
        return pa.table({c: pa.array(np.concatenate(found[c]) if found[c] else [], kind) for c, kind in kinds.items()})

    met = left.groupBy("group", "width", "page").cogroup(right.groupBy("group", "width", "page"))
    met = stored(met.applyInArrow(meet, "anchor bigint, tag int, part int, block string, most bigint, reach bigint"), "choices")
    reach = met.groupBy("anchor", "tag").agg(F.max("reach").alias("least"))
    return met.join(reach, ["anchor", "tag"]).where("most >= least").select("anchor", "tag", "part", "block")


def read_windows(asks: DataFrame, chosen: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(anchor, tag, id, score): the best ``k`` rows, without the anchor, each window has in each block it reads."""
    windows = asks.select("group", "anchor", F.explode(F.arrays_zip("tags", "floors", "ceilings")).alias("w")).select(
        "group", "anchor", F.col("w.tags").alias("tag"), F.struct("w.*").alias("w")
    )
    # a row an anchor and block, with the windows that read it
    want = chosen.join(windows, ["anchor", "tag"]).groupBy("group", "anchor", "part", "block").agg(F.array_sort(F.collect_list("w")).alias("windows"))
    want = want.join(asks.select("anchor", "v", "width"), "anchor")
    cells = stored(want.select("group", "part", "block").distinct(), "reads")
    # the comparison holds for all rows; it lets Spark prune the folders by what is asked for
    rows = blocks.join(cells.where("part >= 0"), ["part", "block"]).select("group", "block", "id", "v")
    kinds = {"anchor": pa.int64(), "tag": pa.int32(), "id": pa.int64(), "score": pa.int64()}

    def read(_, want, rows):
        out: dict[str, list] = {c: [] for c in kinds}
        if want.num_rows and rows.num_rows:
            width = want["width"][0].as_py()
            ids = rows["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], flat(rows["v"].combine_chunks(), width)[order]
            for start in range(0, want.num_rows, 256):
                some = want.slice(start, 256).combine_chunks()
                scores = products(flat(some["v"].combine_chunks(), width), x)
                for anchor, line, asked in zip(some["anchor"].to_pylist(), scores, some["windows"].to_pylist(), strict=True):
                    line[ids == anchor] = -FAR
                    floor, ceiling = (np.array([w[c] for w in asked], np.int64) for c in ("floors", "ceilings"))
                    for w, at in zip(asked, best_in_window(line, floor, ceiling, k), strict=True):
                        for values, more in zip(out.values(), (np.full(len(at), anchor), np.full(len(at), w["tags"]), ids[at], line[at]), strict=True):
                            values.append(more)
        return pa.table({c: pa.array(np.concatenate(out[c]) if out[c] else [], kind) for c, kind in kinds.items()})

    return want.groupBy("group", "block").cogroup(rows.groupBy("group", "block")).applyInArrow(read, "anchor bigint, tag int, id bigint, score bigint")


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """Each window's best ``k`` rows with their rank; ties by id."""
    best = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90, scale: int = SCALE,
    block: int = BLOCK, bits: int = BITS, group: int = GROUP, page: int = PAGE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Anchors are the rows whose id ``every`` divides. Rows with a null id, label, vector or
    component, or one that is not finite, take no part. An id that occurs several times
    counts once, with its least label and components. Vectors of different lengths are not
    compared; empty ones have score 0 with each other. Scores must fit into a long. Without
    anchors, positives or rows in a window there are no rows. Other columns are not read.
    """
    rows = stored(usable(vectors, scale, id_col, vector_col, label_col), "rows")
    blocks = in_blocks(rows, block, bits)
    zones = stored(zone_maps(blocks), "zones")
    anchors = rows.where(F.col("id") % every == 0)
    groups = max(1, -(-anchors.count() // group))
    one = lambda value, kind: F.array(F.lit(int(value)).cast(kind))
    anchors = anchors.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.col("id").alias("anchor"), "label", "width", "v")
    ask = stored(anchors.select("*", one(0, "int").alias("tags"), one(-FAR + 1, "bigint").alias("floors"), one(FAR, "bigint").alias("ceilings")), "asks")
    # one row more is sure to be there: the anchor's own
    found = read_windows(ask, choose(ask, zones, positives + 1, True, page), blocks, positives)
    best = stored(first_rows(found, positives).select("anchor", F.col("rank").alias("tag"), F.col("id").alias("positive"), F.col("score").alias("p")), "positives")
    # least * p <= 100 * n <= most * p, which a positive below 0 leaves empty
    floor, ceiling = F.expr(f"({least_percent} * p + 99) div 100"), F.expr(f"({most_percent} * p) div 100")
    window = best.where("p >= 0").select("anchor", F.struct("tag", floor.alias("floor"), ceiling.alias("ceiling")).alias("w")).where("w.floor <= w.ceiling")
    window = window.groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("w"))
    ask = ask.drop("tags", "floors", "ceilings").join(window, "anchor")
    ask = stored(ask.select("*", F.col("w.tag").alias("tags"), F.col("w.floor").alias("floors"), F.col("w.ceiling").alias("ceilings")).drop("w"), "asks")
    found = first_rows(read_windows(ask, choose(ask, zones, negatives, False, page), blocks, negatives), negatives)
    return found.join(best, ["anchor", "tag"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )
