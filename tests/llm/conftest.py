import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    base = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, base, "en", "a", 300, "x", "y"),
        (2, base, "en", "a", 300, "x", "y"),
        (3, base + " more", "en", None, 305, None, None),
        (3, base + " more", "en", None, 305, None, None),
        (4, None, None, None, None, None, None),
        (5, "", "fr", "b", 0, "", ""),
        (6, " \t\n ", "fr", "b", 4, "", ""),
        (None, "one two three four", "de", "b", 18, "q", "q"),
        (None, None, None, None, None, None, None),
        (7, long, "de", "a", len(long), "q", "q"),
        (8, "Mail me: Ann.B+c@mail.example.com or +1 (523) 555-1055, host 227.5.221.1", "en", "a", 70, "", ""),
        (9, "same same same " * 30, "en", "a", 450, "", ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 1, 0), (9, 0, 0), (9, 0, 0), (None, 1, 1), (5, None, None), (8, 1, 1), (77, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def table(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
