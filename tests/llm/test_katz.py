import math
import zlib
from collections import Counter

import numpy as np

from wardlog.llm import katz


def discounts(counts):
    n = Counter(counts.values())
    half = [1.0] + [(r - 0.5) / r for r in range(1, katz.K + 1)]
    if any(not n[r] for r in range(1, katz.K + 2)):
        return half
    common = (katz.K + 1) * n[katz.K + 1] / n[1]
    if common >= 1:
        return half
    d = [1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, katz.K + 1)]
    return d if all(0 < x < 1 for x in d[1:]) else half


class Brute:
    def __init__(self, rows):
        self.one, self.two, self.context = Counter(), Counter(), Counter()
        for doc_id, text in rows:
            if not self.held_out(doc_id):
                before = "<start>"
                for w in self.tokens(text):
                    self.one[w] += 1
                    self.two[before, w] += 1
                    self.context[before] += 1
                    before = w
        self.d1, self.d2 = discounts(self.one), discounts(self.two)
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.rest = 1 - sum(self.cut(c, self.d1) for c in self.one.values()) / self.n if self.n else 1.0
        self.used, self.mass = Counter(), Counter()
        for (v, w), c in self.two.items():
            self.used[v] += self.cut(c, self.d2) / self.context[v]
            self.mass[v] += self.word(w)

    @staticmethod
    def held_out(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    @staticmethod
    def cut(c, d):
        return d[c] * c if c <= katz.K else c - katz.DELTA

    def word(self, w):
        return self.cut(self.one[w], self.d1) / self.n if self.one[w] else self.rest

    def pair(self, v, w):
        if self.two[v, w]:
            return self.cut(self.two[v, w], self.d2) / self.context[v]
        return (1 - self.used[v]) / (1 - self.mass[v]) * self.word(w) if self.context[v] else self.word(w)

    def scores(self, text):
        before, score, base, known = "<start>", 0.0, 0.0, 0
        for w in self.tokens(text):
            score += math.log10(self.pair(before, w))
            base += math.log10((self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1)))
            known += self.one[w] > 0
            before = w
        return len(self.tokens(text)), known, self.n, base, score


def check(df, monkeypatch=None):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    model = Brute(rows)
    got = sorted(map(tuple, katz.katz_scores(df).collect()), key=str)
    want = sorted(((i, Brute.held_out(i), *model.scores(t)) for i, t in rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    return model


def test_given_documents_match_brute_force(table):
    model = check(table("documents"))
    for v in ["<start>", b"the", b"of", next(iter(model.one))]:  # every context adds up to 1
        total = sum(model.pair(v, w) for w in model.one) + model.pair(v, b"\x00never")
        assert abs(total - 1) < 1e-9


def test_many_partitions_and_slices(table, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 1 << 14)
    monkeypatch.setattr(katz, "SLICE", 1 << 15)
    monkeypatch.setattr(katz, "HOT", 50)
    check(table("documents").repartition(4))


def test_order_of_many_words_and_partitions():
    """Pieces, words and documents of a slice whose packed sort key needs over 63 bits."""
    rng = np.random.default_rng(1)
    for limits in ((597 * 16, 400_000, 400_000, 10_000), (597 * 16, 4_000, 4_000, 100)):
        columns = [rng.integers(0, m, 5_000) for m in limits]
        got = katz.in_order(list(columns), limits[0], limits[1], limits[3])
        assert list(zip(*map(np.ndarray.tolist, got))) == sorted(zip(*map(np.ndarray.tolist, columns)))


def test_odd_rows(odd_docs, no_docs, spark):
    check(odd_docs)
    assert katz.katz_scores(no_docs).count() == 0
    held = [i for i in range(200) if Brute.held_out(i)][:3]
    rows = katz.katz_scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id bigint, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.score) for r in rows] == [(0, 0, 0.0)] * 3


def test_packing_of_arrays():
    for a in (np.array([], np.int32), np.array([5, 1, 2**40], np.int64), np.array([3, 9, 2**63], np.uint64), np.array([0.5, -1e300])):
        assert (katz.unpack(katz.pack(a), a.dtype) == a).all()
        if a.dtype.kind != "f":
            assert (katz.unpack(katz.pack(a, True), a.dtype, True) == a).all()
