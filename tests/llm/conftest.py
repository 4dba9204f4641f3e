import pytest


@pytest.fixture()
def docs_of(spark):
    """documents rows from texts (or (doc_id, text) pairs), with columns whose
    names the operators use inside."""
    def make(texts, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "digest", 7, "node") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "digest string, n long, node string").repartition(partitions)
    return make


#: Texts that every operator must take.
ODD = [None, "", " \n\t", "a", "É", "x" * 5000, "word " * 3000, "the same text", "the same text", "The Same Text",
       "\x00\x01", "😀 emoji 中文字 ß", None, ""]


@pytest.fixture()
def odd():
    return list(ODD)
