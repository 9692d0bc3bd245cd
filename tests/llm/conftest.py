import pytest

EDGES = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b", "en"), (4, "one two", "en"), (5, "one two", "en"), (6, "The quick brown fox jumps over the lazy dog and runs away home now", "en"),
    (7, "the quick brown fox jumps over the lazy dog and runs away home now", "en"), (7, "the quick brown fox jumps over the lazy dog and runs away home now", "en"), (None, "the quick brown fox jumps over the lazy dog and runs away home now", None),
    (8, "Ünï cödé \x1c line\nA repeated line of twenty chars\n", "de"), (9, "x\nA repeated line of twenty chars", "de"), (10, " a REPEATED line of twenty chars \nA repeated line of twenty chars", "de"),
    (11, " ".join(f"w{i % 900}" for i in range(6000)), "en"), (12, " ".join(f"w{i % 900}" for i in range(5990)), "en"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [(d, t, s, "k", 5, 7) for d, t, s in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, n long, rep long")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false").cache()
