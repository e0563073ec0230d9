import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "en", "b"),
            (5, "ALPHA beta gamma delta epsilon", "en", "a"), (5, "ALPHA beta gamma delta epsilon", "en", "a"),
            (6, "one two", "fr", "a"), (7, LONG, "en", "a"), (8, "Mail x.y@example.org or +1 (212) 555-0100", None, "a"),
            (9, "größer ñandú 日本語 😀 <|endoftext|>", "de", "c"), (None, "no id here", "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("shard", "size", "score", "print", "key", "label", "__text", "kind", "entity", "place", "n", "pos", "a", "b", "count"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
