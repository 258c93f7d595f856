import pytest

ODD_ROWS = [
    (3, "a  b\n\n c don't <|x|>", "en", "s", 1),
    (1, "", "en", None, 0),
    (2, None, None, "s", None),
    (3, "a  b\n\n c don't <|x|>", "en", "s", 1),
    (None, "no id", "en", "s", 5),
    (5, "ñandú 日本 語 " * 3000, "es", "s", 9),
    (6, "x" * 30000, "en", "s", 9),
]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD_ROWS, schema).withColumns({"start": F.lit("x"), "score": F.lit(1), "n": F.lit(2), "key": F.lit("k"), "count": F.lit(0)})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
