import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s0"))) for r in rows]
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in full], SCHEMA)

    return build
