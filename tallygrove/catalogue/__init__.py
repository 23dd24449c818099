"""Registered queries, each over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tallygrove.catalogue import cleaning, evaluation, flows, models, patterns, registry, statistics  # noqa: F401

    return dict(registry.QUERIES), dict(registry.TWINS)
