import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts, or from (id, text) pairs; more columns by name."""
    def build(rows, **more):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        kinds = "".join(f", `{name}` string" for name in more)
        return spark.createDataFrame(
            [(i, t, "en", "src", len(t or ""), *more.values()) for i, t in pairs], DOCUMENTS + kinds)
    return build
