"""Byte-level BPE ids of all documents, and the bytes that they decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import byte_bpe
from tallygrove.llm.queries import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_bpe.encode(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
