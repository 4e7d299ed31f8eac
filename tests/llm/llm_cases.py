import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
        ("n_chars", T.LongType()), ("n_words", T.StringType()), ("sequence_id", T.StringType()), ("row", T.StringType()),
    )]
)
PLAIN = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i % 17} thing{i}" for i in range(40))
#: Null and empty texts, ties, repeated rows, a null id, odd white space, one very long text and one very long word.
TEXTS = [
    (1, PLAIN), (2, PLAIN), (2, PLAIN), (3, PLAIN + " tail end"), (4, None), (5, ""), (6, " \t\n "), (7, "One"),
    (8, "one"), (9, OTHER), (10, "x " + OTHER + " " + PLAIN), (None, PLAIN), (None, None), (11, "a  b c\x85d 😀 \x1c e"),
    (12, "the cat sat on the mat and " * 3000), (13, "z" * 5000), (14, OTHER.upper()), (15, PLAIN + " " + PLAIN),
]


@pytest.fixture(scope="session")
def rows():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c") for i, t in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
