"""Groups of documents linked by the similarity of their word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import near_duplicates
from tallygrove.llm.queries import table


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(table(spark, folder, "documents"))
