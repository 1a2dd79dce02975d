import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, rank int, size string, key string, band string, node string, part string"


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), "b", 1, "x", "k", "y", "n", "p")


LONG = " ".join(f"word{n % 5000} and {n}" for n in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [row(1, "the same text stands here twice and more"), row(1, "the same text stands here twice and more"), row(1, "another text under the same number"), row(2, None), row(3, ""), row(None, "no number here at all"), row(None, None, None), row(4, LONG, None), row(5, "the same text stands here twice and more"), row(6, "\n\n \t"), row(7, "für İK é 𝒳 " * 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
