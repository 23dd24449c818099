"""Exact k nearest neighbours between two tables of any size.

Training rows are grouped around pivots (about the square root of their number, chosen by hash). Distances to the
pivots bound which groups can hold a neighbour of a query:

1. each query searches the nearest groups that together hold k rows, which gives it a radius no
   neighbour can lie beyond;
2. it then searches the other groups that reach into the radius, and no more.

A group is divided into blocks of bounded size and so are the queries that visit it, so a pivot
that draws a third of all rows only means more blocks. A task compares one block of queries with
one block of rows as arrays and emits the k best per query; pairs never become rows. No candidate
is capped, the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.scalars import hash_order
from tallygrove.session import shared_folder

BLOCK = 32_768  # rows, and queries, one task compares at a time: a row is shuffled once for each block of the other side
BLOCK_BYTES = 64 << 20
GROUP = 4096  # rows of a group, about
MAX_PIVOTS = 16_384
PIVOT_BYTES = 64 << 20
TILE = 1 << 22  # distances held at once inside a task
FIXED_SEED = 7


def _unpack(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def _pivots(train: DataFrame, pivots: int | None) -> tuple[np.ndarray, int]:
    n = train.count()
    width = train.select(F.size("vec")).first()[0]
    want = pivots or max(1, min(math.isqrt(n), n // GROUP, MAX_PIVOTS, PIVOT_BYTES // (8 * width)))
    # the lowest hashes: a filter on the hash first, so that no task ranks more than a few too many
    enough = min(1.0, (want + 10 * math.sqrt(want) + 10) / n)
    hashed = train.withColumn("_h", hash_order("id", FIXED_SEED)).where(F.col("_h") <= int(enough * 2**52))
    rows = hashed.orderBy("_h", "id").limit(want).collect()  # bounded in number and bytes
    return np.array([r.vec for r in rows], dtype=np.float64), n


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""

    @F.pandas_udf("struct<cell:int,far:double>")
    def nearest(vecs: pd.Series) -> pd.DataFrame:
        d = _distances(_unpack(vecs), pivots)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "far": d[np.arange(len(d)), cell]})

    return df.withColumn("_at", nearest("vec")).select(*df.columns, "_at.cell", "_at.far")


def _first_cells(pivots: np.ndarray, held: np.ndarray, reach: np.ndarray, k: int) -> Callable:
    """Nearest groups of a query until they hold k rows."""

    @F.pandas_udf("array<int>")
    def pick(vecs: pd.Series) -> pd.Series:
        order = np.argsort(_distances(_unpack(vecs), pivots) + reach[None, :], axis=1, kind="stable")
        enough = (np.cumsum(held[order], axis=1) < k).sum(1) + 1
        return pd.Series([order[i, :m].astype(np.int32) for i, m in enumerate(enough)])

    return pick


def _other_cells(pivots: np.ndarray, reach: np.ndarray) -> Callable:
    """Groups, other than those searched, that may hold a row within the radius."""
    slack = 1e-6 * (1.0 + np.abs(pivots).max())

    @F.pandas_udf("array<int>")
    def pick(vecs: pd.Series, done: pd.Series, radius: pd.Series) -> pd.Series:
        d = _distances(_unpack(vecs), pivots)
        may = (d - reach[None, :]) <= radius.to_numpy()[:, None] + slack
        out = []
        for i, seen in enumerate(done):
            may[i, seen] = False
            out.append(np.flatnonzero(may[i]).astype(np.int32))
        return pd.Series(out)

    return pick


def _search(queries: DataFrame, train: DataFrame, k: int, held: np.ndarray, block: int, skip_self: bool) -> DataFrame:
    """``queries`` (id, vec, cells) against the training rows of those cells: (id, neighbour,
    distance), the k best of every block met."""
    blocks = F.lit([max(1, math.ceil(int(h) / block)) for h in held])
    visits = queries.select("id", "vec", F.explode("cells").alias("cell"))
    met = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # per pivot
    chunks = F.lit([max(1, math.ceil(met.get(c, 0) / block)) for c in range(len(held))])
    piece = F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).cast("int")
    chunk = F.pmod(F.xxhash64("id"), F.get(chunks, F.col("cell"))).cast("int")
    left = visits.select(
        "id", "vec", "cell", chunk.alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("cell")) - 1)).alias("piece"),
    )
    right = train.where(F.col("cell").isin(list(met))).select(
        "id", "vec", "cell", piece.alias("piece"),
        F.explode(F.sequence(F.lit(0), F.get(chunks, F.col("cell")) - 1)).alias("chunk"),
    )
    key = ["cell", "piece", "chunk"]

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        a, b = _unpack(q["vec"]), _unpack(t["vec"])
        q_ids, t_ids = q["id"].to_numpy(), t["id"].to_numpy()
        want = min(k + 1, len(b))
        slack = 1e-6 * (1.0 + np.abs(a).max() + np.abs(b).max())
        out = []
        step = max(1, TILE // len(b))
        for lo in range(0, len(a), step):
            rough = _distances(a[lo : lo + step], b)
            near = np.partition(rough, want - 1, axis=1)[:, want - 1]
            i, j = np.nonzero(rough <= (near + slack)[:, None])
            i = i + lo
            if skip_self:
                other = q_ids[i] != t_ids[j]
                i, j = i[other], j[other]
            exact = np.sqrt(((b[j] - a[i]) ** 2).sum(1))
            order = np.lexsort((t_ids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i)  # where the query's run starts
            kept = np.arange(len(i)) - first < k
            out.append(pd.DataFrame({"id": q_ids[i[kept]], "neighbour": t_ids[j[kept]], "distance": exact[kept]}))
        return pd.concat(out, ignore_index=True)

    return (
        left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "id long, neighbour long, distance double")
    )


def knn(
    train: DataFrame,
    query: DataFrame,
    k: int,
    id_col: str = "id",
    vec: str = "vec",
    skip_self: bool = False,
    pivots: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(id, neighbour, distance, rank)``: the k nearest training rows, ties by neighbour id.

    ``skip_self`` leaves a row out of its own neighbours where both inputs are one table. Ids are
    integers, vectors arrays of numbers.
    """
    def shape(df: DataFrame) -> DataFrame:
        # single precision stays as it is until tasks compare, half as long to shuffle
        single = df.schema[vec].dataType.simpleString() == "array<float>"
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<float>" if single else "array<double>").alias("vec"))

    rows, asked = shape(train), shape(query)
    centre, n = _pivots(rows, pivots)
    block = max(1, min(block, BLOCK_BYTES // (8 * max(1, centre.shape[1]))))
    celled = _with_cell(rows, centre)
    stats = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    held, reach = np.zeros(len(centre), dtype=np.int64), np.zeros(len(centre))
    for r in stats:
        held[r.cell], reach[r.cell] = r.n, r.far
    need = min(n, k + 1 if skip_self else k)

    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    first = asked.withColumn("cells", _first_cells(centre, held, reach, need)("vec"))
    shared_folder(train.sparkSession)
    # read three times below: kept as a table so that the search runs once
    found = _search(first, celled, k, held, block, skip_self).checkpoint()
    radius = (
        found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        .groupBy("id").agg(F.max("distance").alias("radius"))
    )
    second = (
        first.join(radius, "id")
        .withColumn("cells", _other_cells(centre, reach)("vec", "cells", "radius"))
        .select("id", "vec", "cells")
    )
    more = _search(second, celled, k, held, block, skip_self)
    return (
        found.unionByName(more)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def knn_vote(neighbours: DataFrame, labels: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """Majority label among each query's neighbours; ties go to the nearer, then the lower id."""
    named = neighbours.join(labels.select(F.col(id_col).cast("long").alias("neighbour"), F.col(label).alias("_label")), "neighbour")
    votes = named.groupBy("id", "_label").agg(
        F.count(F.lit(1)).alias("votes"), F.min(F.struct("distance", "neighbour")).alias("nearest")
    )
    best = F.min_by(F.struct("_label", "votes"), F.struct((-F.col("votes")).alias("v"), F.col("nearest")))
    return votes.groupBy("id").agg(best.alias("b")).select("id", F.col("b._label").alias("predicted"), F.col("b.votes").alias("votes"))
