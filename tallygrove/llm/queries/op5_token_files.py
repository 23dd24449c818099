"""Ids of all documents, written in patched blocks and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import token_files
from tallygrove.llm.queries import table
from tallygrove.session import fresh_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def query(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    token_files.write(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), END_ID, path)
    return token_files.digests(spark.read.parquet(path))
