import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns.
CLASH = {"size": 1, "key": "k", "sha": "s", "hash": 5, "label": 7, "row_": 2, "target": 0.5, "norm": "n", "repeats": 9, "length": 3, "n": 4}


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, copies, repeated rows, ties, a long text, clashing columns."""
    from pyspark.sql import functions as F

    base = "one two three four five six seven eight nine ten"
    rows = [
        (1, base, "en", "a", 1), (2, base.replace(" ", "  "), "en", "a", 1), (3, base.upper(), "en", "b", 1), (3, base.upper(), "en", "b", 1), (4, None, None, None, None), (5, "", "en", None, 0),
        (6, " \t\n", "en", "c", 3), (7, "word " * 30_000, "en", "c", 9), (8, "héllo wörld ñ", "fr", "b", 9), (9, "a b", "en", "b", 3), (10, base + " eleven", "en", "c", 2), (None, "no id here at all", "en", "a", 1), (11, "x", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
