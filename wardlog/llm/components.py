"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Each round points every node at its smallest neighbour, follows the pointers
    twice and replaces link ends by what they point to; links inside a group
    vanish. The smallest node of a component never points elsewhere, so it names
    the component. Minima are combined before they are shuffled, and each round
    is written to the shared folder, so the plan stays short. Null ends and loops
    are ignored; an empty table gives no rows.
    """
    links = stored(
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(),
        "links",
    )
    found = None
    while True:
        ways = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = ways.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = _jump(stored(up, "parents"))
        up = stored(up, "parents")
        found = up if found is None else _follow(found, up)
        found = stored(found, "components")
        near = up.select(F.col("u").alias("u"), F.col("p").alias("pu"))
        far = up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        links = links.join(near, "u").join(far, "v")
        links = stored(
            links.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .where("u < v")
            .distinct(),
            "links",
        )
        if links.isEmpty():
            return found.select(F.col("u").alias("node"), F.col("p").alias("component"))


def _follow(found: DataFrame, up: DataFrame) -> DataFrame:
    """Labels that now point elsewhere are replaced."""
    step = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
    return found.join(step, "p", "left").select("u", F.coalesce("q", "p").alias("p"))


def _jump(up: DataFrame) -> DataFrame:
    for _ in range(2):
        up = _follow(up, up)
    return up
