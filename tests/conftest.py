import os
import sys

import numpy as np
import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """A DataFrame [id, vec] (or other names) of a matrix, ids from ``first``."""

    def make(values, names=("id", "vec"), first=0, partitions=3):
        rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(np.asarray(values, dtype=np.float32))]
        return spark.createDataFrame(rows, f"{names[0]} bigint, {names[1]} array<float>").repartition(partitions)

    return make


@pytest.fixture(scope="session")
def found():
    """{query: [ids in rank order]} of a result."""

    def read(frame):
        out = {}
        for row in sorted(frame.collect(), key=lambda r: (r.q_id, r["rank"])):
            out.setdefault(row.q_id, []).append(row.id)
        return out

    return read


def uniform(rows, dim, seed):
    return np.random.default_rng(seed).random((rows, dim)).astype(np.float32)


def clustered(rows, dim, seed):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(8, dim))[draw.integers(0, 8, rows)] + 0.15 * draw.normal(size=(rows, dim))).astype(np.float32)
