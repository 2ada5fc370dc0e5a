import pytest

#: Documents with every edge case: nulls in each column, empty and blank texts, repeated rows and texts, a long text, marks beyond ASCII.
LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 3), (4, "one", "de", "b", 3), (5, "one two", "de", "b", 7),
    (6, "The same TEXT as another, word for word.", "en", "a", 1), (6, "The same TEXT as another, word for word.", "en", "a", 1),
    (7, "the same text as another, word for word.", "fr", None, 1), (None, "no id here " + PASSAGE, "en", "b", 1), (None, None, None, None, None),
    (8, f"before {PASSAGE} after", "en", "a", 1), (9, f"{PASSAGE} {PASSAGE}", "en", "c", 1), (10, "ñandú übermäßig 漢字かな 🙂 " * 40, "es", "c", 1),
    (11, "ab" * 600, "en", "c", 1), (12, LONG, "en", "a", 1), (13, LONG[:-5] + "tail", "en", "a", 1), (14, "x" * 199, "en", "a", 1), (15, "x" * 200, "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what operators use inside.
CLASHING = ["row", "key", "id", "starts", "n", "start", "hash", "_id", "_node", "node", "words", "keep", "low", "size", "bucket", "hits", "items", "media"]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def text_of(row):
    return row["text"] or ""
