"""Documents with everything that an operator must bear: nulls, empty and long texts, repeats, clashing names."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = [
    "_row", "_size", "_digest", "_bands", "_print", "_document", "_text", "_base", "_tested", "_long", "key", "class",
    "word", "times", "number", "score", "row_number", "_bucket", "held_out", "u", "v", "root", "selected", "first", "ids",
]


def words(seed, n, base="wort"):
    rng = random.Random(seed)
    return " ".join(base + rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    long_text = words(1, 30_000)
    return [
        (1, words(2, 60), "en", "s", 1),
        (2, words(2, 60), "en", "s", 1),  # an exact copy
        (3, words(2, 60) + " ende", "en", "s", 1),  # a near copy
        (4, None, "en", None, None),
        (5, "", None, "s", 0),
        (6, " \n\t ", "en", "s", 3),
        (7, long_text, "en", "s", len(long_text)),
        (None, words(3, 40), "en", "s", 1),
        (None, None, None, None, None),
        (8, words(4, 30), "en", "s", 1),
        (8, words(4, 30), "en", "s", 1),  # a repeated row
        (8, words(5, 30), "en", "s", 1),  # a repeated id
        (9, "x", "en", "s", 1),
        (-1, "Ünïcode Ω ǆ \U0001f600 <|endoftext|> é", "de", "s", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd documents with further columns of clashing names."""
    frame = spark.createDataFrame(odd_rows, COLUMNS).repartition(3)
    for name in CLASHING:
        from pyspark.sql import functions as F

        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
