import pytest

#: Rows every operator must survive: NULLs, empty and blank texts, ties, a repeated row, a long text.
ODD = [
    (None, "a row without an identifier", "en", "s", 27), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4),
    (4, "word " * 60, "en", "s", 300), (4, "word " * 60, "en", "s", 300), (5, "x" * 100_000, None, "s", 100_000), (6, "One. Two, three!\nfour five six\n" * 4000, "de", None, 124_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may carry them too.
CLASH = ["words", "w", "kept", "gone_id", "gone_lines", "slot", "hub", "bucket", "ids", "row", "component_id", "line", "h", "label_id", "pair_doc", "node", "n_words"]


def clashing(frame):
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in frame.columns])


@pytest.fixture(scope="session")
def odd(spark):
    return clashing(spark.createDataFrame(ODD, SCHEMA))


@pytest.fixture(scope="session")
def none(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest data set, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def byte_bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
