import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("keep_id", "fp", "root", "id", "rank", "score")]])
LONG = "lorem ipsum dolor sit amet consetetur " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, mail a.b@c.org.", "en"), (2, "The  quick brown\tfox jumps over the lazy dog, mail a.b@c.org.", "en"), (2, "The  quick brown\tfox jumps over the lazy dog, mail a.b@c.org.", "en"),
    (3, "", "en"), (4, None, None), (5, " \n\t ", "de"), (6, "12345 --- 678", "de"), (7, LONG, "la"), (8, LONG + "x", "la"), (None, "ohne Nummer", "de"), (9, "Der schnelle Fuchs springt über den Hund", None), (10, "日本語のテキスト", "ja"), (11, "Ёлка и дом", "ru"), (12, " ", None), (13, " ", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, l, None, None, "k", None, "r", "i", None, "s") for i, t, l in TEXTS], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
