import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, digest long, epoch int, count long, component string, score double"


def rows(texts):
    return [(i, t, "en", "src1", len(t or ""), 1, "k", 2, 3, 4, "c", 0.5) for i, t in texts]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with extra columns that bear names the operators use inside."""
    return lambda *texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and repeated ids."""
    long_text = " ".join(f"word{i % 9973} goes" for i in range(120_000))
    data = rows([(1, ""), (2, "one"), (3, "same text here again and again"), (3, "same text here again and again"), (4, "same text here again and again"), (5, long_text), (6, "\n\t "), (7, "é ü 語 text\x00with odd bytes")])
    data += [(None, "no id at all in this row", None, None, None) + (None,) * 7, (8, None, None, None, None) + (None,) * 7, (None,) * 12]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
