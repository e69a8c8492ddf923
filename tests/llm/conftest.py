import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with names that operators use."""
    long = " ".join(f"wort{i % 977} und" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today.", None, "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today.", None, "a"),
        (3, None, "en", None), (None, None, None, None), (None, "Ein Text ohne Nummer.\nZweite Zeile.", "de", "b"), (4, "", "en", "b"), (5, long, "de", "a"),
        (6, "12 34 --- !!!", "en", "c"), (7, "\n\n \t\n", "fr", "c"), (8, "kurz", "de", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("id", "key", "did", "block", "slot", "position", "score", "h", "s", "n", "w", "region", "doc", "label", "html", "count"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
