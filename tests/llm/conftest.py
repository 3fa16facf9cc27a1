import pytest

# A long text, repeated rows, ties, empty and null texts, a null id, a null source.
LONG = " ".join(f"wort{i}" for i in range(9000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line of the first document", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nanother line of some other document", "a"),
    (3, "", "b"), (4, None, "b"), (5, None, None), (6, " \n\t ", None), (None, "text without an id", "c"),
    (7, "same text twice in the table", "c"), (7, "same text twice in the table", "c"),
    (8, "same text twice in the table", "b"), (9, LONG, "a"), (10, LONG, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns named like those that operators add or use."""
    from pyspark.sql import functions as F

    names = ("size target taken code component component_id kept anomaly n_words n_lines n_removed spans n_hex score predicted held_out "
             "license coverage notices shard slot line row pos group").split()
    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
