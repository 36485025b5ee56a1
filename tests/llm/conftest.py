import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of texts, with ids from 0."""

    def make(texts, **extra):
        rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
