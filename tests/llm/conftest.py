import pytest

DOC = "doc_id long, text string, score double, node string"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents with extra columns whose names clash with inner ones."""

    def build(rows):
        return spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], DOC)

    return build
