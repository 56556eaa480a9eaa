"""Rows every text operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

ODD_TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a"),
    (2, None, "en", "a"), (3, "", None, None), (4, "   \t\n ", "de", "b"), (5, "one", "en", None),
    (6, "wort " * 30_000, "de", "c"), (6, "wort " * 30_000, "de", "c"), (7, "123 456 !!!", "en", "b"),
    (8, "Ünïcödé süß 漢字 🙂 á", "de", "a"), (None, "a row without an id but with words", "en", "a"),
    (9, "a<|endoftext|>b  two  spaces\n\n \t x", "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, lang string, source string")
    clashing = {c: F.lit(c) for c in ("part", "row", "rank", "fp", "sketch", "bucket", "verdict", "n_tokens", "score", "size")}
    return rows.withColumn("n_chars", F.length("text").cast("long")).withColumns(clashing)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
