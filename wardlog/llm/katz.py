"""A Katz back-off bigram model, counted from and scored over whole corpora.

P(w|v) = d(c) c / c(v) for a pair seen c > 0 times after v, else alpha(v) P(w);
P(w) is the discounted share of w, and all words never seen share what the
discounts leave over. d is the Good-Turing discount for counts up to ``K``. Larger
counts give up ``DELTA`` of a count, so every context keeps some mass to back off
with, and alpha makes each context add up to exactly 1.

Words are 64-bit hashes. Tables are partitioned by word: a row is a partition and
holds sorted arrays, packed; tasks work on them with numpy. A partition holds all
pairs that end in its words, so pair counts, word shares and the scores of seen
pairs are found there in one go; what a context needs for alpha is summed there and
sent to the partition of the context, as are the pairs of held-out texts that
were never seen. Words with ``1 / HOT`` of all tokens (so at most ``HOT`` words)
are spread over all partitions by pair.

Scores depend on the pair discounts only through how many tokens of a text have a
pair count of 1 to ``K``; these numbers are sent along, so one pass is enough.
"""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.llm.words import GOLDEN, as_bytes, held_out, mix, text_slices, word_hashes, words
from wardlog.session import scratch, stored

K, DELTA, HOT = 5, 0.01, 1000
START, END = np.uint64(0), np.uint64(1)
SLICE = 5 << 20
# A partition holds the pairs of about so many bytes of text and is worked on in SUB pieces.
PART_BYTES, LEAST_PARTS, SUB = 48 << 20, 8, 16
# Pairs never seen that a task holds before it packs them for other partitions.
WAITING = 500_000


def pack(a: np.ndarray, differences: bool = False) -> bytes:
    """Bytes of an array; ``differences`` stores steps, which suits sorted numbers."""
    if not len(a):
        return b""
    if differences:
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).data, 1)


def unpack(b: bytes, kind, differences: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    if not b:
        return np.empty(0, kind)
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(kind.itemsize, -1)
    a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if differences else a


def token_ids(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, then the end token."""
    h = word_hashes(words(text))
    h[h < 2] += np.uint64(2)
    return np.append(h, END)


def piece_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids >> np.uint64(32)) % np.uint64(parts * SUB)).astype(np.int64)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return piece_of(ids, parts) // SUB


def by_part(ids: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """The partitions of some ids and the places of their ids, in order."""
    home = part_of(ids, parts)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(parts + 1))
    return [(q, order[a:b]) for q, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def place(found: np.ndarray, sorted_ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each id, 0 where it is not listed."""
    if not len(sorted_ids):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(sorted_ids, found), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == found, values[at], 0)


def discounts(n: dict[int, int]) -> np.ndarray:
    """d(r) for r = 0 (unused) to K from the numbers of things seen r times.

    Good-Turing where the numbers allow it, else half a count is taken off.
    """
    half = np.array([1.0] + [(r - 0.5) / r for r in range(1, K + 1)])
    if any(n.get(r, 0) <= 0 for r in range(1, K + 2)):
        return half
    common = (K + 1) * n[K + 1] / n[1]
    if common >= 1:
        return half
    d = np.array([1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, K + 1)])
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else half


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return np.where(c <= K, d[np.minimum(c, K)] * c, c - DELTA)


def in_order(columns: list[np.ndarray], pieces: int, words: int, docs: int) -> tuple[np.ndarray, ...]:
    """The columns (piece, word, word before, document) sorted by all of them.

    They are packed into one number each where 63 bits hold it. The list is emptied, so
    that no column lives longer than it is needed.
    """
    home, w, v, doc = columns
    columns.clear()
    if int(pieces) * int(words) ** 2 * int(docs) >= 1 << 63:
        order = np.lexsort((doc, v, w, home))
        return home[order], w[order], v[order], doc[order]
    code = home.astype(np.int64)
    del home
    for column, size in ((w, words), (v, words), (doc, docs)):
        code *= size
        code += column
    del w, v, doc, column
    code.sort()
    out = []
    for size in (docs, words, words):
        out.append((code % size).astype(np.int32))
        code //= size
    return code.astype(np.int32), out[2], out[1], out[0]


def give_back() -> None:
    """Returns memory that arrays no longer use to the system, where the C library can: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def settings(spark: SparkSession, **values):
    """Session settings (dots as two underscores) for the jobs run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def few_large_rows(spark: SparkSession, parts: int):
    """For rows of up to a megabyte, dealt by partition number.

    They go to Python tasks a few at a time, as Spark keeps a whole batch twice, and so
    many shuffle partitions are made that hardly two partition numbers share one.
    """
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=16, spark__sql__adaptive__coalescePartitions__initialPartitionNum=8 * parts)


def gathered(batches, limit: int):
    """Small batches put together to about ``limit`` bytes."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


# --- words


def count_words(texts: DataFrame, parts: int) -> DataFrame:
    """(p, words, counts) of the training texts: one row for each partition that has words."""
    kinds = [pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        for part in text_slices(batches, SLICE):
            ids = [token_ids(t) for t, train in zip(part["text"].to_pylist(), part["train"].to_pylist(), strict=True) if train]
            if ids:
                found, n = np.unique(np.concatenate(ids), return_counts=True)
                rows = [(p, pack(found[o], True), pack(n[o].astype(np.int64))) for p, o in by_part(found, parts)]
                del ids, found, n
                yield batch_of(rows, ["p", "words", "counts"], kinds)
        give_back()

    def merge(part):
        found, at = np.unique(np.concatenate([unpack(b.as_py(), np.uint64, True) for b in part["words"]]), return_inverse=True)
        n = np.zeros(len(found), np.int64)
        np.add.at(n, at, np.concatenate([unpack(b.as_py(), np.int64) for b in part["counts"]]))
        return pa.Table.from_batches([batch_of([(part["p"][0].as_py(), pack(found, True), pack(n))], ["p", "words", "counts"], kinds)])

    schema = "p int, words binary, counts binary"
    return texts.select("text", "train").mapInArrow(run, schema).groupBy("p").applyInArrow(merge, schema)


def word_facts(table: DataFrame) -> dict:
    """Totals, counts of counts and the hot words with their counts; the driver sees some thousand numbers."""

    def numbers(batches):
        for batch in batches:
            for b in batch["counts"].to_pylist():
                n = unpack(b, np.int64)
                rows = [("tokens", 0, int(n.sum())), ("words", 0, len(n))]
                rows += [("seen", r, int((n == r).sum())) for r in range(1, K + 2)]
                yield batch_of(rows, ["kind", "r", "n"], [pa.string(), pa.int64(), pa.int64()])

    sums = {(r["kind"], r["r"]): r["n"] for r in table.mapInArrow(numbers, "kind string, r bigint, n bigint").groupBy("kind", "r").agg(F.sum("n").alias("n")).collect()}
    tokens = sums.get(("tokens", 0), 0)

    def frequent(batches):
        for batch in batches:
            for a, b in zip(batch["words"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                ids, n = unpack(a, np.uint64, True), unpack(b, np.int64)
                top = n * HOT >= tokens
                yield pa.RecordBatch.from_arrays([pa.array(ids[top].view(np.int64)), pa.array(n[top])], ["word", "n"])

    hot = table.mapInArrow(frequent, "word bigint, n bigint").collect()
    ids = np.array([r["word"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(ids)
    seen = {r: sums.get(("seen", r), 0) for r in range(1, K + 2)}
    d = discounts(seen)
    size = sums.get(("words", 0), 0)
    taken = sum(r * (1 - d[r]) * seen[r] for r in range(1, K + 1)) + DELTA * (size - sum(seen[r] for r in range(1, K + 1)))
    return {
        "tokens": tokens, "size": size, "d": d, "rest": taken / tokens if tokens else 1.0,
        "hot": ids[order], "hot_n": np.array([r["n"] for r in hot], np.int64)[order],
    }


def share(c: np.ndarray, facts: dict) -> np.ndarray:
    """P(w) of words seen c times; all words of count 0 together have the rest."""
    return np.where(c > 0, discounted(c, facts["d"]) / max(facts["tokens"], 1), facts["rest"])


# --- pairs

POSTINGS = """p int, words array<binary>, runs array<binary>, before array<binary>, doc array<binary>,
    names binary, docs binary, train binary"""
OUT = "kind string, p int, a binary, b binary, c binary, d binary, e binary"
OUT_NAMES = ["kind", "p", "a", "b", "c", "d", "e"]
OUT_KINDS = [pa.string(), pa.int32(), *[pa.binary()] * 5]


def postings(texts: DataFrame, facts: dict, parts: int) -> DataFrame:
    """Each token with the token before it and its document, by partition of the token.

    A row is a partition of a slice of texts; its lists have an entry a piece. names
    lists the tokens before, docs and train the documents; before and doc point there.
    """
    hot = facts["hot"]
    names = ["p", "words", "runs", "before", "doc", "names", "docs", "train"]

    def run(batches):
        for part in text_slices(gathered(batches, SLICE), SLICE):
            ids = [token_ids(t) for t in part["text"].to_pylist()]
            keys = part["key"].to_numpy().view(np.uint64)
            train = part["train"].to_numpy(zero_copy_only=False)
            sizes = np.array([len(x) for x in ids])
            known, w = np.unique(np.concatenate([[START], *ids]), return_inverse=True)
            del ids
            w = w[1:].astype(np.int32)
            v = np.concatenate([np.zeros(1, np.int32), w[:-1]])  # START is the smallest id
            v[np.cumsum(sizes)[:-1]] = 0
            home = piece_of(known, parts).astype(np.int32)[w]
            spread = np.flatnonzero(np.isin(known, hot)[w])
            home[spread] = piece_of(mix(known[w[spread]] * GOLDEN + known[v[spread]]), parts)
            del spread
            columns = [home, w, v, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)]
            del home, w, v
            home, w, v, doc = in_order(columns, parts * SUB, len(known), len(sizes))
            cuts = np.searchsorted(home, np.arange(parts * SUB + 1))
            del home
            rows = []
            for p in range(parts):
                low, high = cuts[p * SUB], cuts[p * SUB + SUB]
                if high == low:
                    continue
                ahead, before = np.unique(v[low:high], return_inverse=True)
                here, local = np.unique(doc[low:high], return_inverse=True)
                before, local = before.astype(np.int32), local.astype(np.int32)
                lists: list = [[], [], [], []]
                for piece in range(p * SUB, p * SUB + SUB):
                    a, b = cuts[piece], cuts[piece + 1]
                    starts = np.flatnonzero(np.diff(w[a:b], prepend=-1))
                    found = (
                        pack(known[w[a + starts]], True), pack(np.diff(starts, append=b - a).astype(np.int32)),
                        pack(before[a - low : b - low], True), pack(local[a - low : b - low]),
                    )
                    for whole, one in zip(lists, found, strict=True):
                        whole.append(one)
                rows.append((p, *lists, pack(known[ahead], True), pack(keys[here]), pack(train[here].astype(np.uint8))))
            del known, w, v, doc, ahead, before, here, local
            batch = batch_of(rows, names, [pa.int32(), *[pa.list_(pa.binary())] * 4, *[pa.binary()] * 3])
            del rows, lists, found
            yield batch
            del batch
        give_back()

    return texts.select("text", "train", "key").mapInArrow(run, POSTINGS)


def doc_rows(keys: np.ndarray, floats: list[np.ndarray], whole: np.ndarray, parts: int) -> list[tuple]:
    """Sums for documents, dealt by document: a = keys, b and c = two sums, d = counts (a row a count)."""
    out = []
    for q, at in by_part(mix(keys), parts):
        at = at[np.argsort(keys[at])]
        out.append(("doc", q, pack(keys[at], True), pack(floats[0][at]), pack(floats[1][at]), pack(whole[:, at].reshape(-1)), b""))
    return out


def count_pairs(found: DataFrame, table: DataFrame, facts: dict, parts: int, keep_pairs: bool = True) -> DataFrame:
    """What each partition of pairs gives: rows of kind doc, context, unseen, pair and seen."""

    total = facts["tokens"] + 0.1 * (facts["size"] + 1)

    def piece(lists, at, names, ahead, docs, train, j, known):
        """Sums by document of one piece, and its pairs."""
        get = lambda c, i, *kind: unpack(lists[c][at[i][0]][at[i][1] * SUB + j].as_py(), *kind)
        each_row = range(len(names))
        w = np.concatenate([np.repeat(get("words", i, np.uint64, True), get("runs", i, np.int32)) for i in each_row])
        v = np.concatenate([names[i][get("before", i, np.int32, True)] for i in each_row])
        doc = np.concatenate([get("doc", i, np.int32) + np.int32(ahead[i]) for i in each_row])
        key = mix(w * GOLDEN + v)
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        w = w[order]
        v = v[order]
        doc = doc[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        c = np.add.reduceat(train[doc].astype(np.int64), starts) if len(key) else np.empty(0, np.int64)
        each = np.repeat(c, np.diff(starts, append=len(key)))
        del key
        n = np.maximum(place(w, *known), place(w, facts["hot"], facts["hot_n"]))
        seen = each > 0
        score = np.log10(np.where(each > K, each - DELTA, np.maximum(each, 1)))
        context = (w != END) & (n > 0)
        score[context] -= np.log10(n[context])
        sums = lambda x: np.bincount(doc, x, len(docs))
        whole = np.stack([sums(None), sums(n > 0), *(sums(each == r) for r in range(1, K + 1))]).astype(np.int32)
        miss = ~seen
        real = starts[c > 0]
        return sums(score), sums(np.log10((n + 0.1) / total)), whole, (w[real], v[real], c[c > 0], n[real]), (v[miss], doc[miss], n[miss])

    def merge(left, right):
        if not left.num_rows:
            return pa.Table.from_batches([batch_of([], OUT_NAMES, OUT_KINDS)])
        p = left["p"][0].as_py()
        # the lists stay in Arrow's memory; each piece is unpacked when its turn comes
        lists = {c: [chunk.flatten() for chunk in left[c].chunks] for c in ("words", "runs", "before", "doc")}
        at = [(k, i) for k, chunk in enumerate(left["p"].chunks) for i in range(len(chunk))]
        names = [unpack(b.as_py(), np.uint64, True) for b in left["names"]]
        docs = [unpack(b.as_py(), np.uint64) for b in left["docs"]]
        ahead = np.cumsum([0, *map(len, docs)])[:-1]
        docs, train = np.concatenate(docs), np.concatenate([unpack(b.as_py(), np.uint8) for b in left["train"]])
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        known = (unpack(right["words"][0].as_py(), np.uint64, True), unpack(right["counts"][0].as_py(), np.int64)) if right.num_rows else none
        score, base, whole = np.zeros(len(docs)), np.zeros(len(docs)), np.zeros((K + 2, len(docs)), np.int32)
        seen = np.zeros(K + 1, np.int64)
        rows, missed = [], []
        # contexts so far, sorted: their ids, masses and numbers of pairs by count
        contexts = none[0], np.empty(0), np.empty((K + 1, 0), np.int32)

        def hand_on():
            """Packs the pairs never seen so far for the partitions of their contexts."""
            v, doc, n = (np.concatenate(x) for x in zip(*missed, strict=True))
            missed.clear()
            for q, o in by_part(v, parts):
                o = o[np.argsort(v[o], kind="stable")]
                here, local = np.unique(doc[o], return_inverse=True)
                rows.append(("unseen", q, pack(v[o], True), pack(local.astype(np.int32)), pack(docs[here]), pack(np.log10(share(n[o], facts))), b""))

        for j in range(SUB):
            one, two, three, (w, v, c, n), miss = piece(lists, at, names, ahead, docs, train, j, known)
            score += one
            base += two
            whole += three
            missed.append(miss)
            seen += [int((c == r).sum()) for r in range(1, K + 2)]
            before, of = np.unique(v, return_inverse=True)
            per = lambda x, of=of, m=len(before): np.bincount(of, x, m)
            many = np.stack([*(per(c == r) for r in range(1, K + 1)), per(c > K)]).astype(np.int32)
            ids, where = np.unique(np.concatenate([contexts[0], before]), return_inverse=True)
            add = lambda old, new, ids=ids, where=where: np.bincount(where, np.concatenate([old, new]), len(ids))
            mass = add(contexts[1], per(share(n, facts)))
            contexts = ids, mass, np.stack([add(x, y) for x, y in zip(contexts[2], many, strict=True)]).astype(np.int32)
            del ids, where, mass, many, add
            if keep_pairs:
                o = np.lexsort((of, w))
                heads = np.flatnonzero(np.concatenate([[True], w[o][1:] != w[o][:-1]])) if len(o) else np.empty(0, np.int64)
                runs = np.diff(heads, append=len(o)).astype(np.int32)
                rows.append(("pair", p, pack(w[o][heads], True), pack(runs), pack(before, True), pack(of[o].astype(np.int32)), pack(c[o].astype(np.int32))))
            if j == SUB - 1 or sum(len(x[0]) for x in missed) > WAITING:
                hand_on()
        before, mass, many = contexts
        for q, o in by_part(before, parts):
            rows.append(("context", q, pack(before[o], True), pack(mass[o]), pack(many[:, o].reshape(-1)), b"", b""))
        rows += doc_rows(docs, [score, base], whole, parts)
        rows.append(("seen", p, pack(seen), b"", b"", b"", b""))
        del lists, names, docs, train, known, score, base, whole, contexts, before, mass, many
        out = pa.Table.from_batches([batch_of(rows, OUT_NAMES, OUT_KINDS)])
        rows.clear()
        give_back()
        return out

    return found.groupBy("p").cogroup(table.groupBy("p")).applyInArrow(merge, OUT)


def weigh_contexts(found: DataFrame, table: DataFrame, facts: dict, d: np.ndarray, parts: int) -> DataFrame:
    """Rows of kind weight (a = contexts, b = alpha) and of kind doc for the pairs never seen."""

    def merge(left, right):
        rows = []
        if left.num_rows:
            p, kind = left["p"][0].as_py(), np.array(left["kind"].to_pylist())
            get = lambda c, i, *how: unpack(left[c][i].as_py(), *how)
            contexts = np.flatnonzero(kind == "context").tolist()
            ids, alpha, n = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64)
            if contexts:
                ids, at = np.unique(np.concatenate([get("a", i, np.uint64, True) for i in contexts]), return_inverse=True)
                mass = np.bincount(at, np.concatenate([get("b", i, np.float64) for i in contexts]), len(ids))
                many = np.concatenate([get("c", i, np.int32).reshape(K + 1, -1) for i in contexts], axis=1)
                many = np.stack([np.bincount(at, x, len(ids)) for x in many])
                known = (unpack(right["words"][0].as_py(), np.uint64, True), unpack(right["counts"][0].as_py(), np.int64)) if right.num_rows else (ids[:0], n)
                n = place(ids, *known)
                n[ids == START] = place(np.array([END]), facts["hot"], facts["hot_n"])[0] or facts["texts"]
                left_over = sum(r * (1 - d[r]) * many[r - 1] for r in range(1, K + 1)) + DELTA * many[K]
                alpha = left_over / n / np.maximum(1 - mass, 1e-300)
                rows.append(("weight", p, pack(ids, True), pack(alpha), b"", b"", b""))
            for i in np.flatnonzero(kind == "unseen").tolist():
                v, local, docs, logs = get("a", i, np.uint64, True), get("b", i, np.int32), get("c", i, np.uint64), get("d", i, np.float64)
                at = np.minimum(np.searchsorted(ids, v), max(len(ids) - 1, 0))
                hit = (ids[at] == v) if len(ids) else np.zeros(len(v), bool)
                total = logs.copy()  # after an unknown word: the share of the word
                # the context's count was taken off with the seen pairs' in count_pairs: put it back
                total[hit] += np.log10(alpha[at[hit]]) + np.log10(n[at[hit]])
                rows += doc_rows(docs, [np.bincount(local, total, len(docs)), np.zeros(len(docs))], np.zeros((K + 2, len(docs)), np.int32), parts)
        return pa.Table.from_batches([batch_of(rows, OUT_NAMES, OUT_KINDS)])

    return found.groupBy("p").cogroup(table.groupBy("p")).applyInArrow(merge, OUT)


def document_sums(found: DataFrame, d: np.ndarray, texts: int) -> DataFrame:
    """(key, score, base_score, n_tokens, n_known) of each document."""
    names = ["key", "score", "base_score", "n_tokens", "n_known"]

    def merge(part):
        every = [unpack(b.as_py(), np.uint64, True) for b in part["a"]]
        keys, at = np.unique(np.concatenate(every), return_inverse=True)
        sums = lambda x: np.bincount(at, np.concatenate(x), len(keys))
        whole = [unpack(b.as_py(), np.int32).reshape(K + 2, -1) for b in part["d"]]
        counts = np.stack([sums([w[j] for w in whole]) for j in range(K + 2)])
        score = sums([unpack(b.as_py(), np.float64) for b in part["b"]]) + np.log10(d[1:]) @ counts[2:]
        base = sums([unpack(b.as_py(), np.float64) for b in part["c"]])
        columns = (keys.view(np.int64), score, base, counts[0].astype(np.int64), counts[1].astype(np.int64))
        return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))

    return found.groupBy("p").applyInArrow(merge, "key bigint, score double, base_score double, n_tokens bigint, n_known bigint")


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that no live plan refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


class KatzModel:
    """The tables of a fitted model below one folder, and the scores of the texts it was counted with.

    words: (p, words, counts). pairs: rows of kind pair, a piece of a partition each (a =
    words, b = how many pairs each ends, c = names of the words before, d = places
    there, e = counts). weights: rows of kind weight (a = contexts, b = alpha).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10):
        spark: SparkSession = docs.sparkSession
        train = ~held_out(id_col, folds)
        key = F.xxhash64(id_col, text_col)
        texts = docs.select(as_bytes(text_col), train.alias("train"), key.alias("key"))
        self.rows = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (~train).alias("held_out"), key.alias("key")), "texts")
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        parts = max(LEAST_PARTS, -(-size // PART_BYTES))
        self.words = stored(count_words(texts, parts), "words")
        drop_shuffles(spark)
        facts = word_facts(self.words)
        facts["texts"] = self.rows.where("not held_out").count()
        self.facts, self.parts = facts, parts
        path = scratch(spark, "pairs")
        with few_large_rows(spark, parts):
            count_pairs(postings(texts, facts, parts), self.words, facts, parts).write.partitionBy("kind").parquet(path)
        drop_shuffles(spark)
        read = lambda: spark.read.schema(OUT).parquet(path)
        seen = {r: 0 for r in range(1, K + 2)}
        for row in read().where("kind = 'seen'").select("a").collect():  # a row a partition
            for r, n in enumerate(unpack(row["a"], np.int64), 1):
                seen[r] += int(n)
        self.d = discounts(seen)
        waiting = read().where("kind in ('context', 'unseen')")
        weights = scratch(spark, "weights")
        weigh_contexts(waiting, self.words, facts, self.d, parts).write.partitionBy("kind").parquet(weights)
        drop_shuffles(spark)
        self.pairs = read().where("kind = 'pair'")
        self.weights = spark.read.schema(OUT).parquet(weights).where("kind = 'weight'")
        late = spark.read.schema(OUT).parquet(weights)
        self.sums = document_sums(read().where("kind = 'doc'").unionAll(late.where("kind = 'doc'")), self.d, facts["texts"])

    def scores(self) -> DataFrame:
        copies = self.rows.groupBy("key").agg(F.count("*").alias("_copies"))
        start = float(np.log10(self.facts["texts"])) if self.facts["texts"] else 0.0
        # rows equal in id and text share a key and have been added up
        each = self.sums.join(copies, "key").select(
            "key",
            (F.col("score") / F.col("_copies") - start).alias("score"),
            (F.col("base_score") / F.col("_copies")).alias("base_score"),
            *((F.col(c) / F.col("_copies")).cast("bigint").alias(c) for c in ("n_tokens", "n_known")),
        )
        return self.rows.join(each, "key").select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(self.facts["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score"
        )


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of ``docs``.

    Learned from all rows outside the held-out fold; rows with a null id are learned
    from. A null or empty text is its end token alone. Repeated rows are learned from
    and scored each. Without training rows every text has probability 1. An empty
    table gives no rows. Other columns are not read.
    """
    return KatzModel(docs, id_col, text_col, folds).scores()
