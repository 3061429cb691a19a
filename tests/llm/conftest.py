import pytest

LONG = "word " * 50_000 + "a-1-" * 10_000 + " " + "1" * 20_000 + " http://" + "x" * 10_000  # words, a candidate, digits, a url
MESSY = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 57),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here but some words to read and score", None, "b", None),
    (4, " \n\t ", "fr", None, 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, "7", "de", "b", 1),
    (7, "zażółć gęślą jaźń 日本語 \U0001f600", None, "", 24),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(MESSY, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, messy):
    """Extra columns with the names that operators use."""
    from pyspark.sql import functions as F

    names = ["language", "secret_spans", "pii_spans", "key", "id", "block", "train", "size", "target", "copies", "chunk", "share", "leaf", "paths", "host", "path", "rule", "verdict", "n", "numbers", "gram", "item_id",
             "_language", "_id", "_key", "_spans", "_doc_id", "_copies", "__size", "__hash", "text_key", "id_hash", "found_language", "row_hash", "salt", "input_part", "words", "kept", "notices"]
    return messy.select("*", *[F.lit("x").alias(n) for n in names])
