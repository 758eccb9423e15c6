"""Near-duplicate vectors of one label by product quantisation.

Vectors are scaled to length 1. A coarse quantiser deals each vector of a label to
the list of its nearest centroid; what is left is coded by one of ``CODES`` centroids
in each of ``PARTS`` subspaces. Both are trained on ``SAMPLE`` vectors (a bounded,
documented sample); every vector is indexed.

A vector lies on its list's side of each plane half way between the list's centroid and
another one. A query probes a list unless all vectors within the threshold's angle lie
beyond one of these planes (its own list's, or those of the ``PLANES`` nearest centroids),
so no neighbour is missed, whatever the data. Of two lists one only asks the other, and a
pair found counts for both sides. In a list, distances come from a table of the query's
subspace distances (asymmetric); a candidate stays if this distance, less the stored
coding error, reaches the radius, which loses none either. What stays is decided on the
exact cosine. Lists are cut into blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.components import components
from wardlog.session import stored

SAMPLE, LISTS, LIST_ROWS, PARTS, CODES, BLOCK, PLANES = 20_000, 1_024, 512, 8, 64, 2_000, 8
SLACK = 1e-6


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre."""
    d = (centres**2).sum(1) - 2 * x @ centres.T
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at] + (x**2).sum(1), 0)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at, _ = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


@dataclass
class Codec:
    """Coarse centroids and a code book for each subspace."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Codec:
        coarse = k_means(x, lists, 1)
        at, _ = nearest(x, coarse)
        rest = x - coarse[at]
        edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        cuts = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return Codec(coarse, [k_means(rest[:, c], CODES, 2 + j) for j, c in enumerate(cuts)], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        at, _ = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        found = [nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)]
        codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        return at, codes, np.sqrt(((rest - decoded) ** 2).sum(1))

    def probes(self, x: np.ndarray, at: np.ndarray, cosine: float) -> np.ndarray:
        """Which lists (columns) can hold a unit vector of at least ``cosine`` with each row of ``x``, of lists ``at``."""
        turn = np.arccos(np.clip(cosine, -1, 1))
        near, size = x @ self.coarse.T, (self.coarse**2).sum(1)
        inner = self.coarse @ self.coarse.T
        apart = np.maximum(size[:, None] + size - 2 * inner, 0)
        can = np.ones(near.shape, bool)
        others = np.argsort(apart + np.diag(np.full(len(size), np.inf)), axis=1)[:, : min(PLANES, len(size) - 1)]
        for other in (at[:, None], *others.T):
            # a vector y of the list has y . (centre - other) of at least the middle's
            along = near - (near[:, other] if other.ndim == 1 else np.take_along_axis(near, other, 1))
            square = apart[np.arange(len(size)), other]
            across = np.sqrt(np.maximum(square - along * along, 0))
            reach = np.where(along >= np.sqrt(square) * np.cos(turn), np.sqrt(square), along * np.cos(turn) + across * np.sin(turn))
            can &= reach >= (size - size[other]) / 2 - SLACK
        return can

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each query to each coded vector of one list, from lookup tables."""
        rest = queries - self.coarse[which]
        total = np.zeros((len(queries), len(codes)))
        for j, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, c]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            total += table[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def local_groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): v is null where the vector cannot be compared; floats stay floats."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # a length that is 0 or leaves the range of doubles gives no direction
    fine = F.col(label_col).isNotNull() & ~bad & (size > 0) & (size < float("inf")) & F.col(id_col).isNotNull()
    return vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(fine, F.col(vector_col).cast(kind)).alias("v")
    )


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    Rows are linked if their labels are equal and the cosine, in double precision, is
    at least ``cosine``. A vector that is null, zero, has null or non-finite entries, a
    null label or a null id has no links and is kept; its component is its own id.
    Vectors of different lengths are not compared. Equal vectors of a label are folded
    before the search and counted as links afterwards. Other columns are not read. An
    empty table gives no rows.
    """
    rows = stored(usable_vectors(vectors, id_col, vector_col, label_col), "vectors")
    usable = rows.where("v is not null")
    reps = usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    reps = stored(reps.withColumn("width", F.size("v")), "representatives")
    spread = []
    for (width,) in sorted(map(tuple, reps.select("width").distinct().collect())):  # a row a vector length
        spread.append(_search(reps.where(F.col("width") == width).drop("width"), cosine))
    if not spread:
        found = rows.sparkSession.createDataFrame([], "id bigint, root bigint, links bigint")
    else:
        found = spread[0]
        for other in spread[1:]:
            found = found.unionAll(other)
    found = stored(found, "neighbours")
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_rep = reps.select("label", "v", "id", "copies").join(counts, "id", "left").join(
        groups.withColumnRenamed("node", "id"), "id", "left"
    )
    by_rep = by_rep.select(
        F.col("label").alias("_l"),
        F.col("v").alias("_v"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "id").alias("component"),
    )
    out = rows.join(by_rep, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _search(reps: DataFrame, cosine: float) -> DataFrame:
    """(id, root, links): for each block searched, the rows an id is linked with and one they lead to."""
    sample = reps.orderBy(F.xxhash64("label", "v"), "id").limit(SAMPLE).select("v").toPandas()
    x = unit(np.array(sample["v"].tolist(), np.float64))
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0]
    codec = Codec.fit(x, min(LISTS, max(1, largest // LIST_ROWS)))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    key, kind = "label string, list int", reps.schema["v"].dataType.simpleString()

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                raw = batch["v"].flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                at, codes, error = codec.encode(unit(raw))
                asks = [found for start in range(0, len(raw), 256) for found in asked(unit(raw[start : start + 256]), at[start : start + 256])]
                yield pa.RecordBatch.from_arrays(
                    [batch["label"], pa.array(at.astype(np.int32)), batch["id"], batch["copies"], batch["v"],
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(asks, pa.list_(pa.int32()))],
                    ["label", "list", "id", "copies", "v", "codes", "error", "asks"],
                )

    def asked(x, at):
        """Lists each row asks: its own, and of any two lists that may share pairs one asks the other."""
        lists, own = np.arange(len(codec.coarse)), at[:, None]
        mine = ((lists + own) % 2 == 1) == (own < lists)
        return [np.flatnonzero(row).astype(np.int32) for row in codec.probes(x, at, cosine) & mine | (lists == own)]

    schema = f"{key}, id bigint, copies bigint, v {kind}, codes binary, error double, asks array<int>"
    indexed = stored(reps.select("label", "id", "copies", "v").mapInArrow(index, schema), "index")
    asking = indexed.withColumn("ask", F.explode("asks"))
    # named anew, as both sides come from one table
    asking = asking.select(
        *(F.col(c).alias(c) for c in ("label", "id", "copies", "v")), F.col("ask").alias("list"), (F.col("ask") == F.col("list")).alias("own")
    )
    indexed = indexed.drop("asks")

    def blocks(df, name):
        sizes = df.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        return sizes

    # stored, so that its size is known and the vectors need not be dealt for it
    cut = stored(blocks(indexed, "dn").join(blocks(asking, "qn"), ["label", "list"]), "cuts")
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    data = indexed.join(cut, ["label", "list"]).select("*", block("dn").alias("db"), F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb")).drop("dn", "qn")
    query = asking.join(cut, ["label", "list"]).select("*", block("qn").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("dn") - 1)).alias("db")).drop("dn", "qn")
    cell = ["label", "list", "db", "qb"]

    def compare(_, left, right):
        import pandas as pd

        out = pd.DataFrame({"id": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return out
        xs, qs = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (left, right))
        codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
        error, ids, asking, own = left["error"].to_numpy(), left["id"].to_numpy(), right["id"].to_numpy(), right["own"].to_numpy()
        rough = codec.distances(unit(qs), int(left["list"].iloc[0]), codes)
        i, j = np.nonzero(rough <= radius + error[None, :] + SLACK)
        # both rows of a list ask it: such a pair counts once, other pairs are met once
        met = (asking[i] != ids[j]) & ((asking[i] < ids[j]) | ~own[i])
        i, j = i[met], j[met]
        exact = np.empty(len(i))
        norm_q, norm_x = np.sqrt((qs * qs).sum(1)), np.sqrt((xs * xs).sum(1))
        for s in range(0, len(i), 1 << 15):
            a, b = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            exact[s : s + (1 << 15)] = np.einsum("nd,nd->n", qs[a], xs[b]) / (norm_q[a] * norm_x[b])
        near = exact >= cosine
        i, j = i[near], j[near]
        if not len(i):
            return out
        names = np.unique(np.concatenate([asking[i], ids[j]]))
        a, b = np.searchsorted(names, asking[i]), np.searchsorted(names, ids[j])
        group = local_groups(len(names), a, b)
        links = np.bincount(a, left["copies"].to_numpy()[j], len(names)) + np.bincount(b, right["copies"].to_numpy()[i], len(names))
        return pd.DataFrame({"id": names, "root": names[group], "links": links.astype(np.int64)})

    return data.groupBy(*cell).cogroup(query.groupBy(*cell)).applyInPandas(compare, "id bigint, root bigint, links bigint")
