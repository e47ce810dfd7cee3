"""Documents to training sequences: language ID, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run``
writes every stage's result as Parquet in the shared folder, reads it again, and deletes what no
later stage needs.

Rows are told apart by their running number in the stage's input, not by their id, so repeated
rows and ids are handled; a stage whose input is empty gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import exact, language, near, packing
from nearfield.llm.registry import held_out, vocabulary
from nearfield.llm.shared import recorded, release, settled, without

ROW = "_stage_row"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: a text without any letter goes."""
    model = language.learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return language.predict(docs, model, to=ROW).filter(F.col(f"{ROW}.lang") != language.UNKNOWN).drop(ROW)


def _kept(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that an operator keeps; its document id is (doc_id, running number)."""
    numbered = settled(docs.withColumn(ROW, F.monotonically_increasing_id()))
    judged = operator(numbered.select(F.struct("doc_id", ROW).alias("doc_id"), "text"))
    gone = judged.filter(~F.col("kept")).select(F.col(f"doc_id.{ROW}").alias(ROW))
    return without(numbered, settled(gone), ROW).drop(ROW)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest document id."""
    return _kept(docs, exact.deduplicate)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the smallest document id."""
    return _kept(docs, near.classes)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(packing.pieces(docs, vocabulary()), docs.count())


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("packing", packing_stage)]
#: Language identification and packing can't be said in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        with recorded() as tables:
            docs = settled(stage(spark, docs, sf_dir))
        release(*before, *(t for t in tables if t is not docs))  # the stage's own tables, and what it read
        before = [docs]
    return docs
