import duckdb
import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again until the evening comes to the valley", "en", "a"),
    (2, "The Quick Brown Fox jumps over the lazy dog again and again until the evening comes to the valley", "en", "b"),
    (3, None, "en", "a"),
    (4, "", "en", None),
    (5, "   \n\t ", "en", "c"),
    (6, " ".join(f"word{i % 97}" for i in range(5000)), "en", "a"),
    (7, "short", None, "b"),
    (8, "x" * 900, "en", "b"),
    (9, "Größe naïve 日本語 🙂 it's they'll 123 ½ 'tis", "de", "d"),
    (10, "shared passage " + " ".join(f"p{i}" for i in range(60)) + " tail one", "en", "a"),
    (11, "other start " + " ".join(f"p{i}" for i in range(60)) + " tail two", "en", "a"),
    (12, "x" * 900, "en", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns named as the operators' own."""
    rows = [(None, "same text of a row", "a", 1), (5, "same text of a row", "a", 2), (5, "same text of a row", "a", 2), (5, "another", None, 3), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rid int").withColumn("id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the smallest documents table."""
    return duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def sample_df(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
