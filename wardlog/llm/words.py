"""Words of whole texts inside Python tasks.

A word is a run of bytes other than space and tab to carriage return; letters
A-Z are lower-cased. Both are what ``bytes.lower`` and ``bytes.split`` do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None, lower: bool = True) -> list[bytes]:
    if not text:
        return []
    return (text.lower() if lower else text).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def shingle_set(found: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; a shorter text is one shingle."""
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * GOLDEN + h[j : j + n])
    return np.unique(out)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20, column: str = "text"):
    """Record batches cut so that the texts of each hold about ``limit`` bytes or are one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(text: str | Column = "text", name: str = "text") -> Column:
    """The text as UTF-8 bytes, which Python reads without decoding."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary").alias(name)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into fold 0; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
