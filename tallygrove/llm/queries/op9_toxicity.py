"""Toxicity of all documents, learned from the labels of those not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import toxicity
from tallygrove.llm.queries import table
from tallygrove.llm.sampling import remainder


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_toxic",
        F.size("spans").cast("long").alias("n_spans"),
    )
