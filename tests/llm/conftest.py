import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_of(spark):
    """A documents table of (doc_id, text[, source]) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None) for r in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, ties, repeats and a very long text."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (5, "one two three"), (6, long), (7, long + " tail"), (None, "no id"), (None, None)]
    return rows + [(100 + i, f"the quick brown fox number {i} jumps over the lazy dog again and again {i}") for i in range(40)]
