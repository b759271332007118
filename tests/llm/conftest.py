import pytest


@pytest.fixture
def documents(spark):
    """Builds a small documents table from texts (or (doc_id, text) pairs)."""

    def build(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string")

    return build
