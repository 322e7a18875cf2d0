import pytest

TEXTS = "doc_id long, text string, lang string, a long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with a null row, an empty text, a null id and columns that operators use themselves."""

    def make(texts, extra=True):
        rows = [(i, t, "en", 7) for i, t in enumerate(texts)]
        if extra:
            rows += [(1000, None, None, None), (1001, "", "en", 1), (None, "a row without an id, of some length", "en", 1)]
        return spark.createDataFrame(rows, TEXTS)

    return make
