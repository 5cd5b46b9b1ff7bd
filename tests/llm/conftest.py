import pytest

EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "   \t\n ", None), (4, "one two three", "b"), (5, "one  two\tthree", "b"), (6, "one two three", "b"),
    (7, "é" * 5 + " naïve 漢字 \U0001f600 end", None), (8, "word " * 30_000, "c"), (9, "x" * 200_000, "c"), (10, "a b c d e f g h " * 40, "a"),
    (11, "Licensed under CC BY-NC 4.0.\nCC\n BY. General  Public-License and all rights reserved", "b"),
    (12, "line one here\nline one here\n\n \nline one here \nother", "d"), (13, "# * $ % & | < > plain", "d"), (None, "no id at all", "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empties, long texts, ties, a repeated row and extra columns with clashing names."""
    rows = [(i, t, "en", s, 0, 1, 2, "k", 9) for i, t, s in [*EDGE, EDGE[4]]]
    names = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, key string, taken int"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
