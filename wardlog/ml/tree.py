"""The routing tree: exact splits, node table, parents, feature importance.

A level of the tree takes one pass over the sparse rows: the entries of each node are
counted per (node, feature, value, class), the zeros follow from the node's totals, and
running sums over the sorted values give the class counts on both sides of every split,
without bins. Running sums are made in two steps: inside the ranges a sort cut the values
into, and over one row a range, so no task holds all values of a feature. The driver sees
the best split of each node.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlog.functions.vectors import constant_array
from wardlog.session import stored


def class_names(df: DataFrame, label: str = "label") -> list[str]:
    return sorted(r[0] for r in df.select(label).distinct().collect())


@dataclass
class Node:
    """A node: its class counts, and its split unless it is a leaf (values up to ``threshold`` go left)."""

    counts: list[int]
    feature: int | None = None
    threshold: float | None = None
    left: Node | None = None
    right: Node | None = None

    @property
    def rows(self) -> int:
        return sum(self.counts)

    @property
    def impurity(self) -> float:
        """Gini impurity times the number of rows."""
        return self.rows - sum(c * c for c in self.counts) / self.rows if self.rows else 0.0

    @property
    def depth(self) -> int:
        return 0 if self.left is None else 1 + max(self.left.depth, self.right.depth)

    def place(self, labels: Sequence[str]) -> str:
        """The class of most rows, the first of equals."""
        return labels[max(range(len(labels)), key=lambda i: (self.counts[i], -i))]

    def numbered(self) -> list[tuple[int, int | None, int, Node]]:
        """(number, parent, level, node), a node before its left and then its right subtree."""
        out: list = []

        def walk(node, parent, level):
            number = len(out)
            out.append((number, parent, level, node))
            if node.left is not None:
                walk(node.left, number, level + 1)
                walk(node.right, number, level + 1)

        walk(self, None, 0)
        return out

    def as_dict(self) -> dict:
        kids = {} if self.left is None else {"left": self.left.as_dict(), "right": self.right.as_dict()}
        return {"counts": self.counts, "feature": self.feature, "threshold": self.threshold, **kids}

    @staticmethod
    def of_dict(d: dict) -> Node:
        kids = [Node.of_dict(d[k]) if k in d else None for k in ("left", "right")]
        return Node(d["counts"], d["feature"], d["threshold"], *kids)


def value_of(feature: int) -> Column:
    """A feature of a sparse row."""
    return F.coalesce(F.get("weights", F.array_position("places", feature).cast("int") - 1), F.lit(0.0))


def branch(tree: Node, pick) -> Column:
    """What ``pick`` gives for the leaf a sparse row falls into."""
    if tree.left is None:
        return pick(tree)
    return F.when(value_of(tree.feature) <= tree.threshold, branch(tree.left, pick)).otherwise(branch(tree.right, pick))


def _class_counts(labels: Sequence[str], n: Column | None = None) -> list[Column]:
    one = F.lit(1) if n is None else n
    return [F.sum(F.when(F.col("label") == c, one).otherwise(0)).alias(f"c{i}") for i, c in enumerate(labels)]


def best_splits(rows: DataFrame, labels: Sequence[str]) -> list:
    """(node, feature, low, high, impurity, l0, l1 ...) of the best split of each node that has one.

    ``rows`` have node, label, places and weights. A split lies between two neighbouring
    values low and high; the one with the least impurity is best, of equals the one with
    the first feature, then the least value.
    """
    k = range(len(labels))
    entries = rows.select("node", "label", F.explode(F.arrays_zip(F.col("places").alias("p"), F.col("weights").alias("w"))).alias("e"))
    counted = entries.where("e.w != 0").groupBy("node", F.col("e.p").alias("feature"), F.col("e.w").alias("value")).agg(*_class_counts(labels))
    counted = stored(counted, "values")
    totals = rows.groupBy("node").agg(*[c.alias(f"t{i}") for i, c in enumerate(_class_counts(labels))])
    present = counted.groupBy("node", "feature").agg(*[F.sum(f"c{i}").alias(f"s{i}") for i in k])
    zeros = present.join(totals, "node").select("node", "feature", F.lit(0.0).alias("value"), *[(F.col(f"t{i}") - F.col(f"s{i}")).alias(f"c{i}") for i in k])
    zeros = zeros.where(sum(F.col(f"c{i}") for i in k) > 0)
    order = ["node", "feature", "value"]
    ranged = counted.unionByName(zeros).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    # sums and the last value of the ranges before
    parts = ranged.groupBy("node", "feature", "part").agg(F.max("value").alias("last"), *[F.sum(f"c{i}").alias(f"p{i}") for i in k])
    earlier = Window.partitionBy("node", "feature").orderBy("part")
    ahead = parts.select(
        "node", "feature", "part", F.lag("last").over(earlier).alias("before"),
        *[F.coalesce(F.sum(f"p{i}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"a{i}") for i in k],
    )
    inside = Window.partitionBy("node", "feature", "part").orderBy("value")
    until = inside.rowsBetween(Window.unboundedPreceding, -1)
    sides = ranged.join(ahead, ["node", "feature", "part"]).join(totals, "node").select(
        "node", "feature", F.col("value").alias("high"),
        F.coalesce(F.lag("value").over(inside), F.col("before")).alias("low"),
        *[(F.col(f"a{i}") + F.coalesce(F.sum(f"c{i}").over(until), F.lit(0))).alias(f"l{i}") for i in k],
        *[F.col(f"t{i}") for i in k],
    )
    left = [F.col(f"l{i}").cast("double") for i in k]
    right = [F.col(f"t{i}").cast("double") - x for i, x in enumerate(left)]
    whole = [F.col(f"t{i}").cast("double") for i in k]

    def spread(counts: list[Column]) -> Column:
        n = sum(counts)
        return n - sum(c * c for c in counts) / n

    sides = sides.where(F.col("low").isNotNull())
    # rounded, so that splits into equal parts are equal
    sides = sides.withColumns({"impurity": F.round(spread(left) + spread(right), 9), "all": F.round(spread(whole), 9)}).where("impurity < all")
    found = F.min(F.struct("impurity", "feature", "low", "high", *[f"l{i}" for i in k])).alias("best")
    return sides.groupBy("node").agg(found).collect()  # a row a node


def fit_tree(df: DataFrame, labels: Sequence[str], depth: int) -> Node:
    """A gini tree over label, places and weights, grown level by level; thresholds lie half way between values."""
    tree = Node(list(df.groupBy().agg(*_class_counts(labels)).first()))
    tree.counts = [c or 0 for c in tree.counts]
    level = {0: tree}
    for _ in range(depth):
        open_ = {i: n for i, n in level.items() if n.impurity > 0}
        if not open_:
            break
        numbers = {id(n): i for i, n in open_.items()}
        node = branch(tree, lambda n: F.lit(numbers.get(id(n))).cast("int"))  # noqa: B023
        rows = df.select(node.alias("node"), "label", "places", "weights").where(F.col("node").isNotNull())
        level = {}
        for r in best_splits(rows, labels):
            parent, best = open_[r.node], r.best
            counts = [best[f"l{i}"] for i in range(len(labels))]
            parent.feature, parent.threshold = best.feature, (best.low + best.high) / 2
            parent.left, parent.right = Node(counts), Node([t - c for t, c in zip(parent.counts, counts, strict=True)])
            level |= {2 * r.node: parent.left, 2 * r.node + 1: parent.right}
    return tree


def route(df: DataFrame, tree: Node, labels: Sequence[str]) -> DataFrame:
    """Adds ``route``, the class the tree predicts."""
    return df.withColumn("route", branch(tree, lambda n: F.lit(n.place(labels))))


def save_tree(spark: SparkSession, tree: Node, path: str) -> None:
    spark.createDataFrame([(json.dumps(tree.as_dict()),)], "tree string").write.mode("overwrite").parquet(path)


def load_tree(spark: SparkSession, path: str) -> Node:
    return Node.of_dict(json.loads(spark.read.parquet(path).first().tree))


def parents(nodes: DataFrame) -> DataFrame:
    """(node_num, node_from) for every node with a parent."""
    children = F.array("left", "right")
    return nodes.where(F.col("left") >= 0).select(
        F.explode(children).alias("node_num"), F.col("node_num").alias("node_from")
    )


def node_table(tree: Node, names: Sequence[str], labels: Sequence[str], spark: SparkSession) -> DataFrame:
    """One row per node with its rule, children, parent and level; '-' where it has none."""
    found = tree.numbered()
    numbers = {id(node): number for number, _, _, node in found}
    text = lambda x: "-" if x is None else str(x)
    rows = [
        (
            "-" if node.left else node.place(labels), text(node.threshold), "-" if node.left is None else names[node.feature], number,
            text(parent), text(node.left and numbers[id(node.left)]), text(node.right and numbers[id(node.right)]), level,
        )
        for number, parent, level, node in found
    ]
    schema = """attack_nm string, value string, features string, node_num bigint, node_from string,
        node_to_left string, node_to_right string, level int"""
    return spark.createDataFrame(rows, schema)


def stamped_nodes(nodes: DataFrame, model_id: int, logtime: str, version: str) -> DataFrame:
    """Node rows as stored: display names, model id, run time and version."""
    shown = (
        F.when(F.col("attack_nm") == "injection", "sql injection")
        .when(F.col("attack_nm") == "file_download", "file download")
        .otherwise(F.col("attack_nm"))
    )
    return nodes.select(
        F.lit(model_id).cast("bigint").alias("model_id"),
        F.lit(logtime).cast("timestamp_ntz").alias("logtime"),
        shown.alias("attack_nm"),
        "value", "features", "node_num", "node_from", "node_to_left", "node_to_right", "level",
        F.lit(version).alias("model_ver"),
    )


def importances(tree: Node, features: int) -> list[float]:
    """The impurity each feature's splits take away, as shares of all."""
    out = [0.0] * features
    for _, _, _, node in tree.numbered():
        if node.left is not None:
            out[node.feature] += node.impurity - node.left.impurity - node.right.impurity
    whole = sum(out)
    return [x / whole for x in out] if whole else out


def importance_table(tree: Node, names: Sequence[str], model_id: int, logtime: str, spark: SparkSession) -> DataFrame:
    """One row per feature with its importance and the weekday and hour of the run."""
    values = constant_array(importances(tree, len(names)))
    pairs = F.arrays_zip(F.split(F.lit("\n".join(names)), "\n").alias("feature"), values.alias("value"))
    run = F.lit(logtime).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(pairs).alias("p")).select(
        F.lit(model_id).cast("bigint").alias("model_id"),
        run.alias("logtime"),
        F.lit("total").alias("attack_nm"),
        F.weekday(run).cast("string").alias("weekday"),
        F.date_format(run, "HH").alias("dayhour"),
        F.col("p.feature").alias("feature"),
        F.col("p.value").alias("value"),
    )
