"""K-means and its single steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.session import shared_folder

TASK_NUMBERS = 1 << 18  # vector entries a task of an iteration has at least, if there are several tasks


def _packed(df: DataFrame, features: str) -> DataFrame:
    """The vectors alone, written once, in no more partitions than their number needs.

    Every task of every iteration reports to the driver, for each step of the plan behind its rows: a plan cut off and
    tasks in proportion to the vectors keep that small.
    """
    shared_folder(df.sparkSession)
    vectors = df.select(features).checkpoint()
    entries = vectors.agg(F.sum(F.size(vector_to_array(features)))).first()[0] or 0
    parts = max(1, math.ceil(entries / TASK_NUMBERS))
    if vectors.rdd.getNumPartitions() <= parts:
        return vectors
    # the order of rows is part of the drawn first centres: sorted, it is the same on a rerun
    return vectors.repartition(parts).sortWithinPartitions(features).checkpoint()


def kmeans(df: DataFrame, k: int, seed: int, features: str = "features") -> tuple[KMeansModel, list[list[float]]]:
    """Fitted model and its centres in ascending order."""
    model = KMeans(k=k, maxIter=300, tol=1e-4, seed=seed, featuresCol=features).fit(_packed(df, features))
    return model, sorted(c.tolist() for c in model.clusterCenters())


def squared_distance(vec: Column, centre: Sequence[float]) -> Column:
    parts = F.zip_with(vec, F.lit([float(v) for v in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def kmeans_assign(df: DataFrame, centres: Sequence[Sequence[float]], vec: str, out: str = "cluster") -> DataFrame:
    """Number of the nearest centre, the lower one of equals, and the squared distance to it.

    The centres are a few rows of fitted state and enter the plan as literals; ``vec`` is an array
    of doubles.
    """
    choices = [
        F.struct(squared_distance(F.col(vec), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)
    ]
    best = F.array_min(F.array(*choices))
    return df.withColumn("_best", best).select(
        *df.columns, F.col("_best.i").alias(out), F.col("_best.d").alias(f"{out}_distance")
    )


def lloyd_step(df: DataFrame, centres: Sequence[Sequence[float]], vec: str) -> DataFrame:
    """New centre of every non-empty cluster: the mean of its members."""
    assigned = kmeans_assign(df, centres, vec).withColumn("_v", array_to_vector(F.col(vec)))
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("centre")
    )


def inertia(df: DataFrame, centres: Sequence[Sequence[float]], vec: str) -> DataFrame:
    """Rows and total squared distance per cluster."""
    return (
        kmeans_assign(df, centres, vec)
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cluster_distance").alias("inertia"))
    )
