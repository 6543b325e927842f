import pytest

ODD_TEXTS = [None, "", " \n\t ", "one", "A b\n\nC  d", "same text here", "same text here", "über straße 日本", "x" * 70000, "w " * 30000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(k, t, "en", "s", None) for k, t in enumerate(ODD_TEXTS)]
    rows += [(None, "same text here", None, None, 1), (5, "same text here", "en", "s", None), (5, "same text here", "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "'h' AS host, 'x' AS fp, 'y' AS node, 1 AS n, 2 AS weight, 'z' AS toxic, 'v' AS label, 'p' AS path, 7 AS kept"
    return spark.createDataFrame(rows, schema).selectExpr("*", *extra.split(", "))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
