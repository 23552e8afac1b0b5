import os

import pytest

#: Small tables that the tests read where they are there.
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def tiny():
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("no tables here")
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(f"{DATA}/sf0.01"):
        pytest.skip("no tables here")
    return f"{DATA}/sf0.01"


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names clash with those that operators make."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text without an id", "en", None, 23), (3, " \t\n", "de", "a", 3),
        (4, "the same words stand here twice over", "en", "b", 36), (5, "the same words stand here twice over", "en", "b", 36), (5, "the same words stand here twice over", "en", "b", 36),
        (6, long, "en", "b", len(long)), (7, "\U0001f600 naïve ﬁ Ⅳ ß İ 日本語 test", None, "c", 20), (8, "!", "en", "c", 1), (9, "a\x00b \x1f c", "fr", "c", 7),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "n", "f", "y", "h", "k", "blob", "score", "length", "piece", "host", "node", "id", "label", "component_id", "__tm_extra"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
