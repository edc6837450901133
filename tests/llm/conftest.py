import pytest
from llm_helpers import prose

#: Names that operators use inside, as columns of the caller.
EXTRA = "text_hash key id row row_id row_hash copy place words label block turn next fingerprint score class".split()


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to a table of documents, with extra columns of clashing names."""

    def make(rows):
        data = [(i, t, lang, source, None if t is None else len(t), *(["x"] * len(EXTRA))) for i, t, lang, source in rows]
        kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)
        return spark.createDataFrame(data, kinds)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60), "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", "b"),
        (4, " \n\t ", None, None),
        (5, prose(3, 80), "de", "b"),
        (5, prose(3, 80), "de", "b"),
        (None, prose(4, 50), "en", None),
        (None, None, None, None),
        (6, long, "en", "c"),
        (7, prose(2, 60), "en", "c"),
        (8, "one", "en", "c"),
        (9, "12 34 !! ??", "en", "c"),
        (2**60 + 1, prose(5, 40), "de", "a"),
    ]


@pytest.fixture(scope="session")
def odd(documents, odd_rows):
    return documents(odd_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(documents, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    kinds = "doc_id bigint, quality int, toxic int"
    return lambda rows: spark.createDataFrame(rows, kinds)
