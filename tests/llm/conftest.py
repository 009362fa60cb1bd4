import pytest

EDGE_TEXTS = [None, "", " ", "one", "The cat sat on the mat and looked at the dog", "The cat sat on the mat and looked at the dog", "x" * 5000, "Ärger über Öl " * 60]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns under names that the operators use themselves."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", None, 7, "z", 3) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, words string, key int").repartition(3)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(EDGE_TEXTS)
