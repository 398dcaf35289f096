import pytest

#: Rows that every operator on documents must take: nulls, empty and long texts, repeats, ties and columns with odd names.
EDGES = [
    (1, "plain words stand here in a row", "en", "s", 1),
    (1, "plain words stand here in a row", "en", "s", 1),
    (1, "the same id with another text", "en", "t", 2),
    (2, None, None, None, None),
    (3, "", "fr", "", 0),
    (None, "no id at all", "en", "s", 3),
    (None, None, None, None, None),
    (4, " \t\n ", "de", None, 4),
    (5, "very long " * 20_000, "en", "s", 5),
    (-6, "漢字 ünïcode \u2003 wörds 😀 ", "zz", "s\u00e9", 6),
    (7, "plain words stand here in a row", "en", "s", 7),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, score int").withColumnRenamed("lang", "size")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
