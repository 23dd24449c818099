"""Scores of all documents, learned from those not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import neural_lm
from tallygrove.llm.queries import table
from tallygrove.llm.sampling import remainder


def query(spark: SparkSession, folder: str) -> DataFrame:
    scored = neural_lm.score(table(spark, folder, "documents"), remainder("doc_id", 7) != 2)
    return scored.withColumn("held_out", remainder("doc_id", 7) == 2)
