"""Document quality by histogram gradient-boosted trees over text statistics.

Statistics of every whole text are computed once in the tasks and written. The
trees are fitted on at most ``MAX_ROWS`` labelled rows (those with the smallest
hash of their id: a documented bound, as a fitted classifier may have); all
rows are scored. A fitted model is a set of arrays, one row a tree, so scoring
walks all rows of a batch through a tree level by level with numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.words import as_bytes, held_out, spare, text_slices
from wardlog.session import stored

MAX_ROWS, TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 20_000, 80, 4, 64, 0.15, 1.0, 10
STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "upper", "lower", "digits", "exclamations", "bars", "symbols",
    "stops", "commas", "brackets", "other_ascii", "high_bytes", "lines", "top_byte", "distinct_words",
    "top_word", "adjacent", "distinct_pairs", "repeated_lines", "short_words", "titles", "long_words",
)
CLASSES = (
    (range(65, 91),), (range(97, 123),), (range(48, 58),), (b"!",), (b"|",), (b"#*$%&<>",), (b".",), (b",",), (b"(){}[]",),
)


def statistics(text: bytes | None) -> list[float]:
    """The numbers named in ``STATISTICS``; all 0 for an empty or missing text."""
    if not text:
        return [0.0] * len(STATISTICS)
    found = text.split()
    n, size = len(found), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = [counts[list(c)].sum() for (c,) in CLASSES]
    upper, lower, digits, marks, bars, symbols, stops, commas, brackets = kinds
    high = counts[128:].sum()
    blank = counts[32] + counts[9:14].sum()
    other = size - sum(kinds) - high - blank
    lines = [x for x in text.split(b"\n") if x.strip()]
    many = max(n, 1)
    word_counts = Counter(found)
    pairs = set(zip(found, found[1:], strict=False))
    counts[[9, 10, 11, 12, 13, 32]] = 0
    return [
        np.log1p(n), np.log1p(size), (size - blank) / many, upper / max(upper + lower, 1), lower / size, digits / size,
        marks / many, bars / many, symbols / many, stops / many, commas / many, brackets / many, other / many,
        high / size, len(lines) / many, counts.max() / size, len(word_counts) / many,
        max(word_counts.values(), default=0) / many, sum(map(eq, found, found[1:])) / many,
        len(pairs) / max(n - 1, 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(c for w, c in word_counts.items() if len(w) <= 3) / many,
        sum(c for w, c in word_counts.items() if w.istitle()) / many,
        sum(c for w, c in word_counts.items() if len(w) >= 12) / many,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every row of ``docs``."""

    def run(batches):
        for part in text_slices(batches):
            rows = [statistics(t) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(rows, pa.list_(pa.float32()))], ["id", "stats"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), as_bytes(text_col))
    return narrow.mapInArrow(run, "id bigint, stats array<float>")


@dataclass
class Trees:
    """Inner nodes of a tree in heap order, then its leaves: arrays with a row a tree."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def bin_limits(x: np.ndarray) -> list[np.ndarray]:
    """Upper limits of the bins of each column: distinct quantiles."""
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(c, q, method="lower")) for c in x.T]


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of fixed depth for labels 0 and 1; a constant if a class is missing."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    none = Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return none
    limits = bin_limits(x)
    binned = np.stack([np.searchsorted(lim, c, "left") for lim, c in zip(limits, x.T, strict=True)])
    total = np.full(len(y), start)
    found = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            at = (node - first) * BINS
            sums = lambda w, at=at, wide=wide: np.stack([np.bincount(at + b, w, wide * BINS).reshape(wide, BINS) for b in binned]).cumsum(2)
            g, h, c = sums(grad), sums(hess), sums(np.ones(len(y)))
            gain = g**2 / (h + SHRINK) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + SHRINK)
            gain -= g[..., -1:] ** 2 / (h[..., -1:] + SHRINK)
            gain[(c < LEAST) | (c[..., -1:] - c < LEAST)] = 0
            for k in range(wide):
                f, b = np.unravel_index(np.argmax(gain[:, k]), gain[:, k].shape)
                if gain[f, k, b] > 1e-9:
                    feature[first + k], limit[first + k] = f, limits[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        at = node - inner
        leaf = RATE * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + SHRINK)
        total += leaf[at]
        found.append((feature, limit, leaf))
    return Trees(start, *(np.stack(part) for part in zip(*found, strict=True)))


def training_rows(stats: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & ~held_out("id"))
    # keep the id hash's head first, so that the statistics join only rows that are used
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    return stats.join(known, "id").orderBy(F.xxhash64("id"), "id", "y", "stats").limit(max_rows).select("stats", "y")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    limit: float = 0.3,
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``.

    ``score`` is the likelihood of label 1 from the text's statistics alone. Label
    rows with a null id or a label other than 0 and 1 are not learned from, nor are
    those of the held-out fold. Empty and null texts have all statistics 0 and are
    scored like others. Repeated rows get equal scores. Without labels of both
    classes every score is the same. Other columns of ``docs`` are not read.
    """
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    rows = training_rows(stats, labels, label, max_rows).toPandas()
    x = np.array(rows["stats"].tolist(), np.float32).reshape(len(rows), len(STATISTICS)).astype(np.float64)
    model = fit_trees(x, rows["y"].to_numpy(np.float64))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch["stats"].flatten().to_numpy().astype(np.float64)
                score = model.score(values.reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score)], ["id", "score"])

    scored = stats.mapInArrow(run, "id bigint, score double")
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        F.when(F.col("score") >= limit, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text is predicted to be of label 0; all columns stay.

    A row goes if any row of its id is predicted 0. Rows with a null id stay.
    """
    id_col = options.get("id_col", "doc_id")
    bad = quality_scores(docs, labels, **options).where("predicted = 0")
    name = spare(docs, "gone")
    bad = bad.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(id_col) == F.col(name), "left_anti")
