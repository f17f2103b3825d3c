import pytest


@pytest.fixture
def frame(spark):
    """Documents with an extra column whose name clashes with those that operators make."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeats and a long text."""
    long = " ".join(f"word{i % 977} other{i % 13}" for i in range(30_000))
    return [
        (1, "The cat sat on the mat and looked at the dog for a long while.", "en", "a"),
        (2, "the CAT sat on the mat and looked at the dog for a long while.", "en", "a"),
        (3, "", "en", "b"),
        (4, " \t\n ", "fr", None),
        (5, None, None, None),
        (6, "one two", "fr", "b"),
        (7, "one two", None, "b"),
        (8, long, "en", "c"),
        (9, "a b c d e f g h a b c d e f g h", "fr", "c"),
        (10, "Ünïcödé wörds — and <|endoftext|> a mark  with   spaces and\x1cseparators", "de", "c"),
        (10, "Ünïcödé wörds — and <|endoftext|> a mark  with   spaces and\x1cseparators", "de", "c"),
        (None, "a text without an id of its own", "en", "a"),
    ]
