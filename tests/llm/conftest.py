import pytest

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text) pairs, in several partitions."""

    def make(rows, partitions=3):
        rows = [row if isinstance(row, tuple) else (at, row) for at, row in enumerate(rows)]
        return spark.createDataFrame(rows, DOCS).repartition(partitions)

    return make


@pytest.fixture
def odd(spark):
    """Null, empty, blank, long and repeated rows, with extra columns of clashing names."""
    words = " ".join(f"w{n}" for n in range(30_000))
    rows = [
        (1, None, None, "a", 1, True),
        (2, "", None, "a", 1, None),
        (3, " \t\n\x0b\x0c\r ", None, None, None, None),
        (4, words, "en", "b", 2, False),
        (5, "one two three", "en", "b", 2, False),
        (5, "one two three", "en", "b", 2, False),
        (6, "no break   naïve 日本 😀\x00 x", "xx", "c", 3, True),
        (None, "a row without a number", "en", "c", 3, True),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, n_words string, key int, kept boolean"
    )


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS + ", lang string, n_words string, key int, kept boolean")


def by_id(df):
    return {row["doc_id"]: row for row in df.collect()}
