import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) with a further column whose name the operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(*r, 1)[:5] if len(r) == 4 else (r[0], r[1], "en", "s", 1) for r in rows],
                                     "doc_id long, text string, lang string, source string, n_words int")

    return make
