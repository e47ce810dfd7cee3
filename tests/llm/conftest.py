import pytest

#: Rows that every operator on documents must stand: null, empty, blank, repeated, long.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "the same text here again and again today"), (5, "the same text here again and again today"), (5, "the same text here again and again today"), (6, "word " * 60_000), (7, "x" * 30_000), (None, "no id, but a text of some six words")]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with further columns whose names the operators use inside."""
    names = ("row", "key", "label", "rank", "kept", "ids", "host", "part", "text_sha256")
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string")
    for n, name in enumerate(names):
        from pyspark.sql import functions as F

        rows = rows.withColumn(name, F.lit(n))
    return rows.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder with the tables given as {name: DataFrame}."""

    def make(**frames):
        folder = str(tmp_path_factory.mktemp("tables"))
        for name, frame in frames.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return make
