"""Quality of all documents, learned from the votes of heuristic labellers on all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import weak_quality
from tallygrove.llm.queries import table


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return weak_quality.score(docs, weak_quality.fit(docs))
