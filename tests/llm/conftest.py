import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture()
def odd(spark):
    """Null, empty, blank, repeated, tied and long texts, a null id and a column of a clashing name."""
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "One two three four five six seven"), (6, "One two three four five six seven"), (None, "one two"), (7, long), (8, long + " x")]
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "clash", 0) for i, t in rows], DOC + ", id string, key int")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOC)
