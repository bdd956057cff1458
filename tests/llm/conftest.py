import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Alpha beta gamma delta.", "en", "a"), (2, "alpha beta  gamma\tdelta.", "en", "a"), (3, "", "en", "b"), (4, None, "en", "b"),
    (5, "one", None, None), (None, "a row without an id", "en", "a"), (None, None, None, None), (7, "words " * 30_000, "en", "a"),
    (8, "x" * 50_000, "en", "c"), (9, "日本語 \U0001F600 ½\n\n\nline", "en", "a"), (9, "日本語 \U0001F600 ½\n\n\nline", "en", "a"),
    (10, "12 34 --- 56", "en", "ä"), (11, "  \n\t ", "fr", ""), (12, "same words here again " * 9, "en", "a"), (13, "same words here again " * 9, "en", "b"),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, a repeated row, and columns that clash with ours."""
    frame = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = ["id", "fp", "component", "size", "at", "cell", "rank", "h", "p", "copies", "grade", "ids", "score", "root", "cut", "n"]
    return frame.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
