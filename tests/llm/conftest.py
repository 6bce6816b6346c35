import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string, component string, `a.b` int, size string, _key int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with further columns of awkward names."""

    def build(*rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src0")), len(r[1] or ""), "x", "y", 1, "z", 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build
