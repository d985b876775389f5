import pytest

SCHEMA = "doc_id long, text string, source string, shard string, score string, host string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon", "a", "s", "q", "h"), (1, "alpha beta gamma delta epsilon", "a", "s", "q", "h"),
        (2, None, None, None, None, None), (None, "alpha beta gamma delta epsilon", "b", None, None, None), (None, None, None, None, None, None),
        (3, "", "a", "", "", ""), (4, " \n\t ", "c", "x", "x", "x"), (5, long, "a", "x", "x", "x"), (6, long + " end", "b", "x", "x", "x"),
        (7, "Alpha BETA gamma delta epsilon", "b", "x", "x", "x"), (8, "ÄÖ ß é 漢字", "ä", "x", "x", "x"), (1, "another text of id one", "a", "x", "x", "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
