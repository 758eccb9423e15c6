"""State of a recurring stream: a merged base and the batches since.

Each batch is written under its id, so a batch that is replayed replaces itself. Now and
then the base and the batches since are merged into a new base, which a marker file with
the last batch it holds makes visible. Readers take the newest base and later batches
only; what older bases and batches hold is in it and can be deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.operators.ordering import union_all
from wardlog.sources.files import Markers

# Batches after which a new base is made.
EVERY = 8


class MergedState:
    """Rows below ``path`` that ``merge`` folds to one row a key.

    ``merge`` takes and gives rows of the same columns; folding folded rows once more must
    change nothing, and the order of rows must not matter.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.spark, self.path, self.merge, self.every = spark, path.rstrip("/"), merge, every
        self._bases = Markers(spark, f"{self.path}/_bases")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Stores what a batch adds; again, if it is replayed."""
        rows.write.mode("overwrite").parquet(f"{self.path}/data/batch_id={batch}")

    def _base(self) -> tuple[int, str | None]:
        """The last batch the newest base holds, and its folder; -1 where there is none."""
        made = self._bases.read()
        newest = max(made, key=int, default=None)
        return (-1, None) if newest is None else (int(newest), f"{self.path}/base/{made[newest]['folder']}")

    def _ids(self) -> list[int]:
        names = self._bases.list(f"{self.path}/data")
        return sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))

    def rows(self, after: int | None = None) -> DataFrame | None:
        """Unmerged rows of the newest base and later batches, or of the batches after one; None without any."""
        upto, folder = self._base()
        first = upto if after is None else after
        found = [self.spark.read.parquet(f"{self.path}/data/batch_id={b}") for b in self._ids() if b > first]
        if folder is not None and after is None:
            found.insert(0, self.spark.read.parquet(folder))
        return union_all(found) if found else None

    def current(self) -> DataFrame | None:
        """The merged rows as of the last batch."""
        rows = self.rows()
        return None if rows is None else self.merge(rows)

    def last(self) -> int:
        """The last batch there is, -1 without any."""
        return max([self._base()[0], *self._ids()])

    def compact(self, force: bool = False) -> bool:
        """Makes a new base if ``every`` batches have come since the last one."""
        upto, _ = self._base()
        new = [b for b in self._ids() if b > upto]
        if not new or (len(new) < self.every and not force):
            return False
        folder = uuid.uuid4().hex
        self.current().write.parquet(f"{self.path}/base/{folder}")
        if self._bases.claim(str(new[-1]), {"folder": folder}):
            return True
        self._bases.delete(f"{self.path}/base/{folder}")  # another start was first
        return False

    def clean(self) -> int:
        """Deletes batches and bases that the newest base covers; not while they are being read."""
        upto, folder = self._base()
        old = [f"{self.path}/data/batch_id={b}" for b in self._ids() if b <= upto]
        if folder is not None:
            old += [f"{self.path}/base/{n}" for n in self._bases.list(f"{self.path}/base") if not folder.endswith(n)]
        for path in old:
            self._bases.delete(path)
        return len(old)


def newest_by(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """Keeps the row of each key with the largest ``order``; of equals the largest row."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [order, *[c for c in rows.columns if c not in (*keys, order)]]
        last = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_last"))
        return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in rows.columns])

    return merge
