import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(20_000))
    rows = [
        (1, "a b c", "s1", "en", 5), (2, "a  b\nc", "s1", None, 6), (2, "a  b\nc", "s1", None, 6),
        (3, None, None, None, None), (4, "", "s2", "en", 0), (5, " \n ", "s2", "en", 3),
        (None, "a b c", "s2", "en", 5), (None, None, None, None, None), (6, long, "s3", "en", 9),
        (7, long, "s3", "en", 9), (8, "abc", "s3", "de", 3), (8, "other text", "s3", "de", 10),
    ]
    schema = "doc_id long, text string, source string, size string, row long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
