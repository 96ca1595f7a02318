import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(texts, **extra):
        """Documents from texts, or from (doc_id, text, source) rows."""
        rows = [t if isinstance(t, tuple) else (i, t, "s") for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)

    return make


#: Texts of every kind that an operator must stand.
ODD = [None, "", " ", "\n\n", "a", "a", "one two three four", "é ü 漢字 🙂", "x" * 30_000, "w " * 5_000, "A\tB\r\nC\x0bD\x0cE", "nul\x00 byte", "  lead and trail  "]
