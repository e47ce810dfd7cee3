"""Where jobs of this folder put what all executors must see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a table that tells which keys may be among some others (at most a few megabytes, whatever the input).
BITS = 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for local masters without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Tables settled since ``recorded`` began, innermost last.
_records: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """A list of the tables that are settled meanwhile, for ``release``."""
    _records.append([])
    try:
        yield _records[-1]
    finally:
        _records.pop()


def settled(frame: DataFrame) -> DataFrame:
    """``frame``, computed once and read from the shared folder, so its lineage ends there.

    A written Parquet table: unlike a checkpoint it is compressed and read by column. It has no
    marker of success: on a local file system, writing one forks the driver's JVM twice.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    frame.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table._settled_path = path
    for record in _records:
        record.append(table)
    return table


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._settled_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def may_be_among(frame: DataFrame, keys: DataFrame, key: str, to: str) -> DataFrame:
    """``frame`` with a column that is false only where its ``key`` is not in ``keys``.

    The keys' hashes set bits in a table of fixed size, which is broadcast. So what surely
    needs no join can be told apart from the rest before anything is shuffled.
    """
    place = lambda: F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    bits = keys.select(place().alias("_p")).groupBy(F.floor(F.col("_p") / 32).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(_p, 32) as int))")).alias("_bits"))
    marked = frame.withColumn("_p", place()).withColumn("_word", F.floor(F.col("_p") / 32)).join(F.broadcast(bits), "_word", "left")
    found: Column = F.expr("coalesce(shiftright(_bits, cast(pmod(_p, 32) as int)) & 1, 0) = 1")
    return marked.withColumn(to, found).drop("_p", "_word", "_bits")


def without(frame: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``frame`` whose ``key`` is not in ``keys``; only those that may be are shuffled."""
    marked = may_be_among(frame, keys, key, "_maybe")
    sure = marked.filter(~F.col("_maybe")).drop("_maybe")
    return sure.unionByName(marked.filter("_maybe").drop("_maybe").join(keys.select(key), key, "left_anti").select(*sure.columns))
