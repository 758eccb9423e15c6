"""Which sparse vectors are like one of a set, found with pivots and the triangle inequality.

Vectors are scaled to length 1, so a cosine of at least t is a distance of at most
r = sqrt(2 - 2t). Each vector of the set lies in the cell of its nearest pivot. A vector x
can have a match v in a cell of pivot p only if its distance to p is within r of the
distances found there, and no other pivot is nearer to x by more than 2r. Cells are asked
nearest first: in the first pass each vector meets its nearest cell, what has a match
there leaves, and only the others go on to the rest of their cells. In a cell, v is
compared if |d(x,p) - d(v,p)| is within r. No bound loses a match; what is compared is
decided on the cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.functions.vectors import total
from wardlog.session import stored

PIVOTS, BLOCK, SLACK = 64, 2_048, 1e-9


def unit_vectors(df: DataFrame, name: str) -> DataFrame:
    """(id, places, weights, unit): each different vector with a length once."""
    rows = df.select("places", F.col("weights").cast("array<double>").alias("weights")).distinct()
    length = F.sqrt(total(F.transform("weights", lambda w: w * w)))
    rows = rows.withColumn("_length", length).where((F.col("_length") > 0) & (F.col("_length") < float("inf")))
    unit = F.transform("weights", lambda w: w / F.col("_length")).alias("unit")
    return stored(rows.select(F.monotonically_increasing_id().alias("id"), "places", "weights", unit), name)


def dense(places, weights, known: np.ndarray) -> np.ndarray:
    """Rows of the sparse vectors, a column for each of the ``known`` places."""
    size = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
    place, w = (x.flatten().to_numpy(zero_copy_only=False) for x in (places, weights))
    out = np.zeros((len(size), len(known)))
    if len(place) and len(known):
        at = np.minimum(np.searchsorted(known, place), len(known) - 1)
        hit = known[at] == place
        out[np.repeat(np.arange(len(size)), size)[hit], at[hit]] = w[hit]
    return out


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def like_any(vectors: DataFrame, others: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(places, weights, compared): the vectors with a cosine of at least ``threshold`` to one of ``others``.

    Both have ``places`` and ``weights``; each different vector is tested once. Vectors
    without a length are like nothing. ``compared`` is how many of ``others`` the vector
    was compared with when its match was found.
    """
    rows, found = search(vectors, others, threshold, pivots, block)
    hits = found.where("hit").groupBy("id").agg(F.sum("compared").alias("compared"))
    return rows.join(hits, "id").select("places", "weights", "compared")


def search(vectors: DataFrame, others: DataFrame, threshold: float, pivots: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The different vectors, and (id, hit, compared) for each block of ``others`` one was compared with."""
    rows, given = unit_vectors(vectors, "vectors"), unit_vectors(others, "others")
    shape = "id bigint, hit boolean, compared bigint"
    centres = given.orderBy(F.xxhash64("places", "weights")).limit(pivots).select("places", "unit").toArrow()
    if not centres.num_rows:
        return rows, rows.sparkSession.createDataFrame([], shape)
    places, unit = (centres[c].combine_chunks() for c in ("places", "unit"))
    known = np.unique(places.flatten().to_numpy(zero_copy_only=False))
    matrix = dense(places, unit, known)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    def to_pivots(batch):
        return distances(dense(batch["places"], batch["unit"], known) @ matrix.T)

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                away = to_pivots(batch)
                cell = away.argmin(1)
                near = away[np.arange(len(cell)), cell]
                columns = [pa.array(cell.astype(np.int32)), pa.array(near), batch["id"], batch["places"], batch["unit"]]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "away", "id", "places", "unit"])

    columns = ("id", "places", "unit")
    homes = stored(given.select(*columns).mapInArrow(home, "cell int, away double, id bigint, places array<int>, unit array<double>"), "cells")
    rings = homes.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high")).collect()  # a row a pivot
    rings = {r.cell: (r.low, r.high) for r in rings}
    cells = np.array(sorted(rings))
    low, high = (np.array([rings[c][i] for c in cells]) for i in (0, 1))

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            away = to_pivots(batch)
            mine = away[:, cells]
            can = (mine - reach <= high) & (mine + reach >= low) & (mine - away.min(1, keepdims=True) <= 2 * reach)
            asks, far = [], []
            for i in range(len(away)):
                at = np.flatnonzero(can[i])
                at = at[np.argsort(mine[i, at], kind="stable")]
                asks.append(cells[at].astype(np.int32))
                far.append(mine[i, at])
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in columns], pa.array(asks, pa.list_(pa.int32())), pa.array(far, pa.list_(pa.float64()))], [*columns, "asks", "far"]
            )

    asking = stored(rows.select(*columns).mapInArrow(ask, "id bigint, places array<int>, unit array<double>, asks array<int>, far array<double>"), "asking")

    def compare(_, data, query):
        ids, hits, counts = [], [], []
        if data.num_rows and query.num_rows:
            data, query = data.combine_chunks(), query.combine_chunks()
            order = np.argsort(data["away"].to_numpy(), kind="stable")
            data = data.take(pa.array(order)).combine_chunks()
            away = data["away"].to_numpy()
            here = np.unique(data["places"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
            matrix = dense(data["places"].combine_chunks(), data["unit"].combine_chunks(), here)
            asked = dense(query["places"].combine_chunks(), query["unit"].combine_chunks(), here)
            ids, far = query["id"].to_numpy(), query["distance"].to_numpy()
            first, last = np.searchsorted(away, far - reach, "left"), np.searchsorted(away, far + reach, "right")
            counts = last - first
            hits = np.zeros(len(ids), bool)
            for i in np.flatnonzero(counts):  # the ring alone, a row at a time
                hits[i] = (matrix[first[i] : last[i]] @ asked[i]).max() >= threshold
        return pa.table({"id": pa.array(ids, pa.int64()), "hit": pa.array(hits, pa.bool_()), "compared": pa.array(counts, pa.int64())})

    def one_pass(ask: DataFrame) -> DataFrame:
        """Compares (id, places, unit, cell, distance) with the vectors of their cells, in blocks."""
        cut = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        blocks = stored(cut(homes, "dn").join(cut(ask, "qn"), "cell"), "blocks")
        place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        data = homes.join(blocks, "cell").select("cell", "away", "id", "places", "unit", place("dn").alias("d"), "qn")
        data = data.withColumn("q", every("qn")).drop("qn")
        query = ask.join(blocks, "cell").select("cell", "distance", "id", "places", "unit", place("qn").alias("q"), "dn")
        query = query.withColumn("d", every("dn")).drop("dn")
        key = ["cell", "d", "q"]
        return stored(data.groupBy(*key).cogroup(query.groupBy(*key)).applyInArrow(compare, shape), "compared")

    rest = F.explode(F.arrays_zip(F.slice("asks", 2, F.size("asks")).alias("cell"), F.slice("far", 2, F.size("far")).alias("distance")))
    nearest = one_pass(asking.where(F.size("asks") > 0).select("id", "places", "unit", F.get("asks", F.lit(0)).alias("cell"), F.get("far", F.lit(0)).alias("distance")))
    left = asking.where(F.size("asks") > 1).join(nearest.where("hit").select("id").distinct(), "id", "left_anti")
    further = one_pass(left.select("id", "places", "unit", rest.alias("p")).select("id", "places", "unit", "p.cell", "p.distance"))
    return rows, nearest.unionAll(further)


def unlike(samples: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``samples`` whose vectors are like none of ``others``; rows without a vector stay."""
    like = like_any(samples, others, threshold).select(F.col("places").alias("_p"), F.col("weights").alias("_w"))
    like = stored(like, "like")
    same = (F.col("places") == F.col("_p")) & (F.col("weights").cast("array<double>") == F.col("_w"))
    return samples.join(like, same, "left_anti")
