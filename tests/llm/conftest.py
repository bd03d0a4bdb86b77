import random

import pytest

pytest.importorskip("detlens.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = ("key", "row", "node", "score", "kept", "component_id", "hits", "ordinal", "_key", "text_hash")


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = "\n".join(words(rng, 40) for _ in range(1500))
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n\r ", "en", None, 5), (4, "one", "en", "b", 3),
        (5, "two words", "de", "b", 9), (6, base, "en", "a", 7), (7, base, "en", "a", 7), (8, " ".join(near), "en", "c", 7),
        (8, " ".join(near), "en", "c", 7), (9, long, "en", "a", 1), (10, long, "en", None, 1), (None, "text without id " + words(rng, 60), "en", "a", 4),
        (None, None, None, None, None), (11, "é ß 日本 語 \U0001f600 x y " * 20, "fr", "é", 2), (12, words(rng, 300), "en", "Z", 3),
        (12, words(rng, 300), "en", "Z", 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
