import pytest

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank at dusk"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns with clashing names."""
    long = " ".join(f"word{i} and{i % 97}" for i in range(60_000))
    rows = [
        (1, PROSE, "en", "a", 100, "x", 1),
        (1, PROSE, "en", "a", 100, "x", 1),
        (2, PROSE + " indeed", "en", "a", 100, "x", 1),
        (3, None, "en", "a", None, None, None),
        (4, "", "fr", None, 0, "x", 2),
        (5, long, "en", "b", len(long), "x", 3),
        (6, "\n\n\n", None, "b", 3, "x", 3),
        (7, "!!! ??? 123", "de", "b", 11, "x", 3),
        (8, "ein", "de", "b", 3, "x", 3),
        (None, "text without an id", "en", "b", 18, "x", 3),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, score int").withColumns({c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1) for c in ("h1", "n", "words", "node", "bucket", "batch", "path", "shingles", "features", "tokens", "fitted", "keeper")})


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
