import pytest

NASTY = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", 0),
    (3, "one two three", None, None, 13),
    (3, "one two three", None, None, 13),
    (None, "no id here at all", "en", "b", 17),
    (5, "é " * 20000, "fr", "b", 40000),
    (6, "x" * 70000, "en", "b", 70000),
    (7, "\n\t \x0b ", "de", "c", 5),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty, blank and very long texts, a repeated row; columns with names that operators use inside."""
    rows = spark.createDataFrame(NASTY, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.selectExpr("*", "1 as rep", "2 as n", "3 as token", "4 as copy", "'z' as ids", "5 as score", "6 as hash")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
