"""Connected components of links that may fill a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.session import fresh_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new folder below the shared one, and read from there: cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _trace(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node of links ``u``, ``v``.

    Large-star and small-star steps by turns until nothing changes: a number of rounds that grows with the logarithm of
    the nodes. Each step is an aggregate of minima and a join that Spark may split where a node has very many links. No
    links give no rows; a loop is a component of one node.
    """
    u, v = F.col("u"), F.col("v")
    links = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    before = _trace(links)
    while True:
        both = links.select("u", "v").union(links.select(v.alias("u"), u.alias("v")))
        least = both.groupBy(u.alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.join(least, u == F.col("w")).filter(v >= u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(u.alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, u == F.col("w"))
        small = small.select(v.alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        links = stored(small.distinct(), "links")
        now = _trace(links)
        if now == before:
            return links.groupBy(u.alias("node")).agg(F.min("v").alias("component"))
        before = now
