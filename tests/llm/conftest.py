import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, one id with two texts, clashing extra columns."""
    word = "lorem ipsum dolor sit amet, "
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b ", "fr", "b"), (4, "hello", None, "a"), (5, "12345 !!", "en", None),
        (6, word * 20_000, "en", "a"), (7, "one two three four five six seven", "en", "a"), (8, "one two three four five six seven", "en", "b"),
        (8, "one two three four five six seven", "en", "b"), (9, "Éa ßö 漢字 \U0001f600 ok", "de", "c"), (10, "x" * 50_000, "en", "c"),
        (12, "first text of one id with words of its own", "en", "a"), (12, "second text of that id about something else altogether", "en", "b"),
    ]
    df = documents(spark, rows)
    clash = ("h", "w", "t", "n", "id", "pos", "src", "score", "language", "bin", "size", "target", "spans", "w_id", "node", "sig", "item_id", "p", "f", "u")
    return df.withColumns({c: F.lit(f"extra {c}") for c in clash if c not in df.columns})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
