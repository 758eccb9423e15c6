"""Repetition inside documents, found with suffix arrays.

The words of many documents are laid end to end; word codes differ between
documents, so no repeat crosses from one to another. Sorting by doubled
prefixes gives the suffix array; only suffixes that still tie are sorted again.
Neighbours in the array give each word the longest stretch that starts there and
occurs elsewhere in its document. A stretch is maximal if the word before it does
not start one that holds it. Maximal stretches of ``MIN_WORDS`` words and more are
united; the share of words they cover and the longest one are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.words import GOLDEN, as_bytes, mix, text_slices, word_hashes

MIN_WORDS, MAX_SHARE, MAX_REPEAT = 12, 0.2, 50
SYMBOLS = b"#*$%&|<>"  # fixed values: characters counted as symbols
WINDOW = 8


def doubled_ranks(codes: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffix array of several sequences and ranks of prefixes of 1, 2, 4 ... codes.

    ``ends`` holds, for each position, the end of its sequence. Equal ranks on a
    level mean equal prefixes of that length within the sequence.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.ones(n, bool)
    head[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return levels, order
        at = order[slots]
        later = at + width
        inside = later < ends[at]
        after = np.zeros(len(at), np.int64)
        after[inside] = rank[later[inside]] + 1
        key = rank[at] * (n + 1) + after
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[slots] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[slots] = fresh
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        levels.append(rank)
        width *= 2


def repeat_lengths(levels: list[np.ndarray], order: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each position the longest stretch of ``least`` or more that occurs elsewhere, else 0."""
    out = np.zeros(len(order), np.int64)
    base = int(np.log2(least))
    if base >= len(levels):
        return out
    near = np.flatnonzero(levels[base][order[1:]] == levels[base][order[:-1]])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < ends[a]) & (y < ends[b])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        common[ok] += 1 << k
    common[common < least] = 0
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a stretch."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return marks[:n].cumsum() > 0


def measure(texts: list[bytes | None], least: int = MIN_WORDS) -> dict[str, np.ndarray | list]:
    """Counts and repeats of each text, as columns."""
    counts = np.zeros((len(texts), 4), np.int64)
    hashes = []
    for i, text in enumerate(texts):
        text = text or b""
        found = text.split()
        hashes.append(word_hashes(found))
        kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        lines = [x for x in text.split(b"\n") if x.strip()]
        inside = len(text) - kinds[128:192].sum() - kinds[32] - kinds[9:14].sum()
        counts[i] = len(found), inside, kinds[list(SYMBOLS)].sum(), len(lines) - len(set(lines))
    sizes = counts[:, 0]
    n = int(sizes.sum())
    last = sizes.cumsum()
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = last[doc] if n else np.zeros(0, np.int64)
    codes = mix(np.concatenate(hashes) + doc.astype(np.uint64) * GOLDEN)
    levels, order = doubled_ranks(codes, ends)

    window = np.zeros(n, bool)
    k = WINDOW.bit_length() - 1
    if k < len(levels):
        rank = levels[k]
        seen = np.flatnonzero((np.bincount(rank, minlength=n) > 1)[rank])
        window = covered(seen, np.full(len(seen), WINDOW), n)

    length = repeat_lengths(levels, order, ends, least)
    starts = np.flatnonzero(length)
    before = np.where(starts > 0, length[starts - 1], 0)
    same = (starts > 0) & (doc[starts - 1] == doc[starts])
    starts = starts[~(same & (before > length[starts]))]
    repeated = covered(starts, length[starts], n)
    first = last - sizes
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[starts], length[starts])
    per_doc = lambda mask: np.bincount(doc[mask], minlength=len(texts))
    spans: list = [[] for _ in texts]
    for s in starts:
        spans[doc[s]].append((int(s - first[doc[s]]), int(length[s])))
    return {
        "n_words": sizes, "word_chars": counts[:, 1], "n_symbols": counts[:, 2], "n_dup_lines": counts[:, 3],
        "n_repeat_words": per_doc(window), "n_covered": per_doc(repeated), "longest_repeat": longest, "repeats": spans,
    }


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def repetition(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, repeats): one row for each row of ``docs``.

    ``repeats`` lists the maximal repeated stretches as (start, length) in words.
    An empty or null text has zeros and no repeats; a null id stays null; repeated
    rows each have their row. Other columns of ``docs`` are not read.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for part in text_slices(batches, 2 << 20):
            if part.num_rows:
                found = measure(part["text"].to_pylist(), least)
                repeats = [[{"start": s, "length": n} for s, n in x] for x in found["repeats"]]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], *(pa.array(found[c]) for c in NUMBERS), pa.array(repeats, spans)],
                    ["doc_id", *NUMBERS, "repeats"],
                )

    schema = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in NUMBERS), "repeats array<struct<start: bigint, length: bigint>>"])
    return docs.select(F.col(id_col).cast("bigint").alias("id"), as_bytes(text_col)).mapInArrow(run, schema)


def with_verdict(measured: DataFrame, max_share: float = MAX_SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds base_failed and kept: the plain limits, then those on covered share and longest repeat."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("n_covered") <= max_share * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
