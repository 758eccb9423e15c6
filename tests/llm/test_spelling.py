import random
import re
import zlib
from collections import Counter, defaultdict

from wardlog.llm import spelling
from wardlog.llm.queries import QUERIES


def brute_counts(docs, least=7, count=2, step=31):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % step == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= count}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(n, times=10):
    near = defaultdict(set)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[:i]:
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)

    def form(w):
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        return best if best and n[best] >= times * n[w] else None

    out = {}
    for w in words:
        root = w
        while form(root):
            root = form(root)
        f = form(w)
        out[w] = (f, root, n[w], len(near[w]), n[f] if f else None)
    return out


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: tuple(r)[1:] for r in rows}


def test_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    want = brute_variants({w: n for w, n in brute_counts(rows).items()} if len(rows) < 50 else brute_counts(rows[:60]))
    docs = table("documents").where(f"doc_id IN ({','.join(str(i) for i, _ in rows[:60])})")
    assert got(spelling.spelling_variants(docs)) == want and any(v[0] for v in want.values())


def test_dense_words(spark):
    """Few letters, so that words share prefixes, suffixes and many neighbours."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(3, 9))) for _ in range(700)} | {"a" * k for k in range(1, 14)}
    n = {w: rng.choice([2, 3, 30, 400, 9000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint").repartition(5)
    assert got(spelling.variants(df)) == brute_variants(n)


def test_long_words(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    at = [5, 9_999, 10_000, 19_999]
    words = [base] + [base[:i] + base[i + 1 :] for i in at] + [base[:i] + "z" + base[i + 1 :] for i in at] + [base + "q", "q" + base, "x" * 5_000, "x" * 5_001]
    n = {w: 10 ** (k % 3) + 1 for k, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert got(spelling.variants(df)) == brute_variants(n)


def test_forms_lead_to_the_last(spark):
    n = {"aaaaaaaa": 10_000, "aaaaaaab": 1_000, "aaaaaabb": 100, "aaaaabbb": 10, "aaaabbbb": 1, "zzzzzzzz": 5}
    rows = got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert rows == brute_variants(n) and rows["aaaabbbb"][1] == "aaaaaaaa"


def test_deleted_letters(spark):
    rows = [(i, f"Wording wordING × wörding{i % 3} Éclairs éclairs ab\u00d7cdefgh longestwordever") for i in range(400)] + [(None, "wording nullable nullable")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want and len(want) > 12 and all(n < 800 for n in want.values())


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    extra = odd_docs.selectExpr("*", "'a' AS word", "1 AS n", "'x' AS form", "true AS backward")
    assert got(spelling.spelling_variants(extra)) == brute_variants(brute_counts(rows))
    assert spelling.spelling_variants(no_docs).count() == 0


def test_whole_table(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    n = brute_counts(rows)
    out = got(QUERIES["op13_spelling_trie_frontier"](spark, "/root/testdata/sf0.001"))
    assert {w: v[2] for w, v in out.items()} == n
