import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        T.StructField("score", T.DoubleType()),
        T.StructField("node", T.StringType()),
        T.StructField("row_key", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("class", T.StringType()),
    ]
)

PROSE = "The river carried the boats past the old mill while people waited on the bank for news of the harvest."


def row(doc_id, text):
    return (doc_id, text, "en", "src", len(text or ""), 1.0, "x", "x", "x", "x")


@pytest.fixture(scope="session")
def documents_schema():
    return DOCUMENTS


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, ties, and clashing columns."""
    rows = [
        row(1, PROSE),
        row(1, PROSE),  # a repeated row
        row(2, PROSE.replace(" ", "  ")),
        row(3, None),
        row(4, ""),
        row(5, " \n\t"),
        row(None, PROSE),
        row(None, "a text without an id"),
        row(7, "word " * 60_000),
        row(8, "é" * 3),
        row(9, "12 34 !!"),
        row(10, PROSE + " Released under the MIT License."),
        row(3, "another text of document three"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def corpus(sf):
    import pandas as pd

    return pd.read_parquet(f"{sf}/documents.parquet")
