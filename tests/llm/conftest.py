"""Documents with odd rows, for all operators."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "one", "en", "b", 3),
    (5, "The quick brown fox jumps over the lazy dog again and again.", "en", "b", 60), (5, "The quick brown fox jumps over the lazy dog again and again.", "en", "b", 60),
    (None, "no id here at all", "en", "c", 17), (7, " \n\n \t ", "de", None, 6), (8, "word " * 30_000, "en", "a", 150_000), (9, "é日本語 ½ \U0001f600 it's", "ja", "c", 12),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1.5) for r in ODD], DOCS + ", score string, size double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
