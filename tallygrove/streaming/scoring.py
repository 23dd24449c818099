"""Scoring rows as they arrive.

The fitted steps are projections of literals, so the batch operators run on a stream as they are;
this only wires source, model and sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallygrove.operators.evaluation import decisions
from tallygrove.session import fresh_path


def decide_stream(
    rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    threshold: float,
    out: str,
    keep: Sequence[str] = ("id",),
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Score a streaming DataFrame and append ``(keep, p, reject)`` to Parquet files under ``out``.

    Handles what is available and stops; pass the same ``checkpoint`` to go on later without
    repeating or losing rows.
    """
    return (
        decisions(score(rows), threshold, keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or fresh_path(rows.sparkSession, "decide"))
        .trigger(availableNow=True)
        .start(out)
    )
