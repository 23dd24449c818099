"""Language of all documents, learned from those not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import language_id
from tallygrove.llm.queries import table
from tallygrove.llm.sampling import remainder


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs.filter(remainder("doc_id", 4) != 2))
    named = language_id.languages(docs, model)
    return named.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
