import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], "doc_id long, text string, id string, words string, fp int, length int")

    return make

