import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and columns, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, None, "en", "b"), (2, "", "en", "b"), (3, " \t\n ", None, None), (4, "Alpha beta gamma delta", "en", "a"),
        (5, "ALPHA beta gamma delta", "en", "a"), (6, "ÄLPHA beta gamma delta", "de", "a"), (6, "ÄLPHA beta gamma delta", "de", "a"),
        (None, "alpha beta gamma delta", "en", None), (None, "no id here", None, "c"), (7, "word " * 60_000, "en", "c"),
        (8, "日本語のテキスト😀 és más", "es", "c"), (9, "x" * 200_000, "en", "c"), (10, "1234 !!! --", "en", "c"), (11, "two words", None, "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("id", "fp", "key", "digest", "run", "size", "salt", "chunk", "bucket", "copies", "a.b", "payload", "root"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
