import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from wardlog.llm import pieces
from wardlog.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.read(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encode(texts, model):
    flat, ends = pieces.encode(texts, model)
    return [x.tolist() for x in np.split(flat, ends[:-1])] if texts else []


def odd_texts():
    rng = random.Random(5)
    letters = "ab the▁  \t\n\0é漢字🙂ก<s>0x41thethe\r\u00a0"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    points = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    out += ["".join(chr(rng.choice(points)) for _ in range(300)) for _ in range(20)]
    out += ["", None, " ", "▁", "▁▁ a", "the" * 2000, " " * 5000, "a" * 6000, "\ufffd x", "ᚠᚢ", "ab" * 3000 + " thinker" * 900]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "<s></s><unk><0x41>"]
    return out


def test_ids_are_those_of_the_library(model, library):
    texts = odd_texts()
    want = library.encode([t or "" for t in texts], num_threads=1)
    assert encode(texts, model) == want
    for limit in (64, 10):  # the heap merges in the same order
        old, pieces.LONG = pieces.LONG, limit
        try:
            assert encode(texts[:400], model) == want[:400]
        finally:
            pieces.LONG = old


def test_texts_come_back(model, library):
    texts = odd_texts()
    ids = encode(texts, model)
    ends = np.cumsum([len(x) for x in ids])
    got = pieces.decode(np.concatenate([np.array(x, np.int64) for x in ids]), ends, model)
    assert got == library.decode(ids)
    assert all(g == (t or "").replace("▁", " ") for g, t in zip(got, texts))


def test_any_ids_are_decoded_as_the_library_does(model, library):
    rng = random.Random(7)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 31_999), rng.randint(3, 258), rng.randint(0, 3)]) for _ in range(rng.randint(0, 14))]
        assert pieces.decode(np.array(ids, np.int64), np.array([len(ids)]), model) == [library.decode(ids)]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "empty.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.Pieces.read(str(path))


def test_whole_table(spark, table, library):
    docs = {r.doc_id: r.text or "" for r in table("documents").collect()}
    rows = QUERIES["op11_sentencepiece_merge_rounds"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, spark, library):
    rows = odd_docs.withColumnsRenamed({"id": "ids", "label": "decoded"})
    got = pieces.decoded(pieces.encoded(rows, PATH), PATH).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.decoded) for r in got) == want
    assert all(list(r.ids) == library.encode(r.decoded) for r in got)
    assert pieces.encoded(no_docs, PATH).count() == 0
    extra = spark.createDataFrame([(1, None, "x", "y"), (2, [4, None, -5, 99_999], None, "z")], "doc_id int, ids array<int>, decoded string, `a.b` string")
    out = {r.doc_id: r for r in pieces.decoded(extra, PATH).collect()}
    assert out[1].decoded == "" and out[2].decoded == "\x01" + " ⁇ " * 3 and out[2]["a.b"] == "z"
