import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a ``documents`` frame from (doc_id, text) pairs, with two columns whose names operators use themselves."""

    def build(rows):
        frame = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)
        return frame.selectExpr("*", "lang as component_id", "source as row", "1 as length", "2 as kept")

    return build


LONG = " ".join(f"word{k}" for k in range(30_000))

ODD = [(None, None), (1, ""), (2, "  \n\t "), (3, "one"), (3, "one"), (None, "One"), (4, LONG), (5, LONG + " end"),
       (6, "Straße ÄÖÜ 日本語 \x00   😀"), (6, "other text of the same id")]


@pytest.fixture
def odd_documents(documents):
    return documents(ODD)


@pytest.fixture
def no_documents(documents):
    return documents([])
