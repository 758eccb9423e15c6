import random

from wardlog.llm import repetition


def brute(text, least):
    w = (text or b"").split()
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    inside = {x for i in range(n) if longest[i] >= least for x in range(i, i + longest[i])}
    windows: dict = {}
    for i in range(n - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {x for v in windows.values() if len(v) > 1 for i in v for x in range(i, i + 8)}
    lines = [x for x in (text or b"").split(b"\n") if x.split()]
    chars = sum(len(x.decode()) for x in w)
    symbols = sum((text or b"").count(bytes([c])) for c in b"#*$%&|<>")
    return n, chars, symbols, len(lines) - len(set(lines)), len(repeated), len(inside), max([x for x in longest if x >= least], default=0)


def test_measures_match_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        texts = [None, b""]
        for _ in range(6):
            pool = ["a", "b", "é", "x|y", "\n"][: rng.randint(1, 5)]
            texts.append(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 50))).encode())
        for least in (3, 8, 12):
            got = repetition.measure(texts, least)
            for i, t in enumerate(texts):
                assert tuple(int(got[c][i]) for c in repetition.NUMBERS) == brute(t, least)


def test_repeats_are_maximal_and_stay_inside_their_document():
    one = "p " + " ".join(f"r{i}" for i in range(15)) + " q " + " ".join(f"r{i}" for i in range(15)) + " s"
    other = " ".join(f"r{i}" for i in range(15))
    got = repetition.measure([one.encode(), other.encode()], 12)
    assert got["repeats"] == [[(1, 15), (17, 15)], []]


def test_verdicts(odd_docs, no_docs, spark):
    passage = " ".join(f"p{i}" for i in range(55))
    filler = lambda k, n: " ".join(f"f{k}_{i}" for i in range(n))
    rows = [
        (1, filler(1, 600)),
        (2, f"{filler(2, 300)} {passage} {filler(3, 300)} {passage}"),  # one long repeat, a small share
        (3, filler(4, 19)),
        (4, "again and again these words " * 10),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.with_verdict(repetition.repetition(df)).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False)}
    odd = repetition.with_verdict(repetition.repetition(odd_docs)).collect()
    assert len(odd) == odd_docs.count() and all(r.base_failed and not r.kept for r in odd if not r.n_words)
    assert repetition.repetition(no_docs).count() == 0
