"""All documents encoded with merge-dropout, and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import sentencepiece_dropout as sp
from tallygrove.llm.queries import table

MODEL = "piece_bpe_32k.model"


def query(spark: SparkSession, folder: str) -> DataFrame:
    checked = sp.encode_and_check(table(spark, folder, "documents"), public_tokenizers.path(MODEL))
    return checked.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        "n_chars",
        "lossless",
    )
