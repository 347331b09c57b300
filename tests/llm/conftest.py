import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts: None stays null; ids count up from 0 unless given."""

    def make(texts, ids=None, extra=""):
        rows = [(i if ids is None else ids[i], t, None if i % 7 == 6 else ("en", "fr")[i % 2], None if i % 5 == 4 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make
