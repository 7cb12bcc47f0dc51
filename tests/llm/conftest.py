import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Column names the operators use themselves, on top of those of the table.
CLASHING = (
    "size long, key double, band int, rank int, copy long, digest string, fp string, score string, "
    "_id long, _n int, _digest string, _times long, _rank int, _kept_id long"
)


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "plain text of a few words that says very little about anything at all", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, "   \n\t ", "en", None),
        (5, long, "en", "a"),
        (6, "plain text of a few words that says very little about anything at all", "de", "b"),
        (6, "plain text of a few words that says very little about anything at all", "de", "b"),
        (7, "same id, one text " * 8, None, None),
        (7, "same id, another text " * 9, "fr", "c"),
        (None, "a row without an id but with a mail me@example.org", "en", "c"),
        (None, None, None, None),
    ]
    extra = (1, 0.5, 2, 3, 4, "x", "y", "z", 5, 6, "q", 7, 8, 9)
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), *extra) for r in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}",
    )


@pytest.fixture
def labels(spark):
    rows = [(i, int(i % 3 != 0), 0) for i in range(1, 12)] + [(1, 0, 0), (None, 1, 0), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
