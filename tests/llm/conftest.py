import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, and clashing extra columns."""
    word = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do "
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "no id here", "de", "b"), (None, None, None, None),
            (4, " \t\n ", "fr", "c"), (5, word * 3000, "en", "a"), (6, word * 3000, "en", "d"), (7, "ß ÄÖ Ünïcode 日本語 \U0001f600 text", "de", None), (8, "one", "fr", "c"), (9, "one", "fr", "c"), (8, "other text with the same id as another row", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", F.lit(1).alias("size"), F.lit("x").alias("n"), F.lit(2).alias("id"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("gid"), F.length("text").cast("long").alias("n_chars"))


@pytest.fixture(scope="session")
def corpus(spark):
    from tests.conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
