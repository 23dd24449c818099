"""Byte-level BPE and SentencePiece ids of all documents, aligned, with corpus-wide counts of their pairs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import alignment
from tallygrove.llm.queries import table

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path
    found = alignment.align(table(spark, folder, "documents"), path(BYTE_LEVEL), path(PIECES), public_tokenizers.PATTERN, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
