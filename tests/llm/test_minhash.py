import random

import numpy as np

from wardlog.llm import minhash, words
from wardlog.llm.components import components


def sets_of(rows, size):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    return out


def brute(rows, size, percent):
    """Component of each row by comparing every pair."""
    sets, label = sets_of(rows, size), [r[0] for r in rows]
    changed = True
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {r[0]: (len(s), c) for r, s, c in zip(rows, sets, label, strict=True)}


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **options).collect()}


def test_given_documents_match_brute_force(table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text").collect()]
    for size, percent in ((3, 85), (5, 80)):
        assert found(table("documents"), shingle=size, percent=percent) == brute(rows, size, percent)


def near_copies(n, seed):
    """Copies of one text with up to a few changed words: many lie close to the threshold."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"c{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_large_group_of_near_copies_in_blocks_and_pairs(spark, monkeypatch):
    rows = near_copies(150, 1) + [(1000 + i, f"other text number {i} of ten words here a{i} b{i} c{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    expected = brute(rows, 3, 85)
    assert len({c for _, c in expected.values()}) > 22
    for few, block in ((16, 128), (0, 16), (10_000, 128)):
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert found(df, shingle=3, percent=85) == expected


def test_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, shingle=3, percent=85).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by_id[i].component_id for i in (1, 2, 3)] == [1, 1, 1] and not by_id[3].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i and by_id[i].kept for i in (4, 5, 6))
    assert by_id[7].n_shingles == 19_998
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_deduplicate_keeps_one_row_of_a_group(odd_docs, no_docs):
    kept = minhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, 7, 8, 9, None, None], key=str)
    assert minhash.deduplicate(no_docs).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (8_000, 1_000, 1_000))
    left, right = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    regs = minhash.registers([left, right, np.union1d(left, right)])
    assert (minhash.merge(regs[0], regs[1]) == regs[2]).all()
    got = minhash.likely_similarity(regs[:1], regs[1:2], np.array([9000.0]), np.array([9000.0]))[0]
    assert abs(got - 0.8) < 0.09
    # cutting the values into slices does not change the registers
    assert (minhash.registers([left])[0] == regs[0]).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(200, 100), (100, 300), (7, 7), (None, 3), (500, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_are_bytes_between_ascii_blanks():
    assert words.words("Ab c\tÄ\x0bX\x1cy".encode()) == ["ab c".encode(), "Ä".encode(), b"x\x1cy"]
