import hashlib
import random
import re

from wardlog.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(df):
    texts = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    rows = sorted(((r.doc_id, r) for r in pii.personal_data(df).collect()), key=str)
    assert len(rows) == len(texts)
    want: dict = {}
    for i, t in texts:
        want.setdefault(i, []).append(base(t))
    for i, r in rows:
        options = [b for b in want[i] if hashlib.sha256(",".join(b).encode()).hexdigest() == r.base_sha256]
        assert options, (i, want[i], r)
        b = options[0]
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(x.startswith(kind) for x in b)
        assert set(b) <= set(filter(None, r.spans.split(",")))
        order = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in filter(None, r.spans.split(",")))]
        assert order == sorted(order)
    return rows


def test_given_documents(table):
    check(table("documents"))


def test_made_up_texts(spark):
    rng = random.Random(4)
    bits = ["a", "é😀", "x.y", "@", "@b.c", ".", "_", "-", " ", "1", "23", "4" * 13, "4111111111111111", "+", "(", "10.0.0.1", "256.1.1.1", "+1 (523) 555-1055", "%"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    rows += [(1000, "a@b" + ".c" * 30_000), (1001, "1 " * 30_000), (1002, "x" * 200_000), (1003, "7" * 100_000)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_further_spans(spark):
    rows = [(i, f"call the phone office now (523) 555-10{i:02d} please") for i in range(30)]
    rows += [(100, "pay by card 4111111111111111 4111111111111111 soon"), (101, "number 4111111111111112 4111111111111112 here")]
    rows += [(200 + i, f"write to user{i}@mail.example.com or +1 (523) 555-10{i:02d} today") for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100] == "card:12:28,card:29:45" and got[101] == ""


def test_redaction(odd_docs, no_docs, spark):
    out = pii.redacted(odd_docs)
    assert out.columns == odd_docs.columns and out.schema["n_chars"].dataType == odd_docs.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert got[8].text == "Mail me: <EMAIL> or <PHONE>, host <IP>" and got[8].n_chars == len(got[8].text)
    before = {r.doc_id: r for r in odd_docs.collect()}
    assert all(got[i].text == before[i].text and got[i].n_chars == before[i].n_chars for i in (1, 4, 5, 7, 9))
    assert pii.redacted(no_docs).count() == 0 and pii.personal_data(no_docs).count() == 0
    both = spark.createDataFrame([(1, "x +4111 1111 1111 1111 y")], "doc_id bigint, text string")
    assert "4111" not in pii.redacted(both).first().text
    check(odd_docs)


def test_reliabilities_tell_good_labelers_from_poor_ones():
    patterns = [((1, 0, 0, 0, 1), 80), ((1, 1, 1, 0, 1), 60), ((-1, -1, 0, -1, -1), 50), ((-1, 0, 0, -1, 0), 30), ((1, -1, 0, 0, 0), 5)]
    prior, likely, chance = pii.reliabilities(patterns)
    assert 0.5 < prior < 0.8 and chance[patterns[1][0]] > 0.95 and chance[patterns[2][0]] < 0.05
    assert likely[0][0][1] > 0.8 > 0.3 > likely[1][0][1]
