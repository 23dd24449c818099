"""Principal components of a long panel: no pivot, no list of its columns on the driver.

Columns (tickers) are numbered by a dictionary and dealt in blocks; a block is the matrix of its columns over all dates. With
T dates and N columns the covariance of N x N numbers has the eigenvalues of the T x T matrix of the dates' products, which is
added up over blocks on executors; loadings, scores and residuals are products of a block and a T x k matrix. So the driver
holds T squared numbers, however many columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.operators.dictionary import CategoryDictionary
from tallygrove.operators.vector_sums import blocks as emit
from tallygrove.operators.vector_sums import summed
from tallygrove.session import fresh_path

BLOCK = 256  # columns of a block
MOST_DATES = 4096  # the driver's matrix has as many rows and columns


@dataclass(frozen=True)
class Panel:
    """``block``, ``names`` (columns), ``cells`` (binary matrix, a row for each date) of every block; the dates in order."""

    blocks: DataFrame
    dates: list = field(repr=False)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names of a block's columns, and the columns."""
    for batch in batches:
        for names, cells in zip(batch.column("names").to_pylist(), batch.column("cells")):
            yield names, np.frombuffer(cells.as_buffer()).reshape(-1, len(names))


def panel_blocks(rows: DataFrame, key: str, date: str, value: str) -> Panel:
    """Blocks of a panel that has a value for each column and date; a missing one is an error. Written to the shared folder."""
    spark = rows.sparkSession
    dates = sorted(r[0] for r in rows.select(date).distinct().limit(MOST_DATES + 1).collect())
    if len(dates) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates")
    numbered = spark.createDataFrame([(d, i) for i, d in enumerate(dates)], f"_date {rows.schema[date].dataType.simpleString()}, _t int") if dates else None
    slots = CategoryDictionary.fit(rows, [key]).index(rows.select(key, date, value)).withColumnRenamed(f"{key}_slot", "_slot")
    n_dates = len(dates)

    def pack(table: pa.Table) -> pa.Table:
        slot, t, x = (table.column(c).to_numpy() for c in ("_slot", "_t", "_x"))
        own = np.unique(slot)
        cells = np.full((n_dates, len(own)), np.nan)
        at = np.searchsorted(own, slot)
        cells[t, at] = x
        if np.isnan(cells).any():
            raise ValueError("the panel lacks a value: align its dates first")
        names = np.empty(len(own), object)
        names[at] = table.column("_key").to_pylist()
        return pa.table({"block": pa.array([int(own[0]) // BLOCK], pa.int32()), "names": [list(names)], "cells": pa.array([cells.tobytes()], pa.binary())})

    path = fresh_path(spark, "panel")
    if numbered is None:
        return Panel(spark.createDataFrame([], "block int, names array<string>, cells binary"), [])
    cells = slots.join(F.broadcast(numbered), F.col(date) == F.col("_date")).select(
        F.floor(F.col("_slot") / BLOCK).cast("int").alias("_block"), "_slot", "_t", F.col(value).cast("double").alias("_x"), F.col(key).cast("string").alias("_key")
    )
    cells.groupBy("_block").applyInArrow(pack, "block int, names array<string>, cells binary").write.parquet(path)  # at most BLOCK columns a group
    return Panel(spark.read.parquet(path), dates)


def covariance_blocks(panel: Panel) -> DataFrame:
    """``col_a``, ``col_b``, ``value``: sample covariance of every pair of columns, from pairs of blocks side by side."""
    n = len(panel.dates)
    ids = F.array([F.lit(r[0]) for r in sorted(panel.blocks.select("block").collect())])  # a number a block
    a = panel.blocks.select(F.col("block").alias("i"), F.col("names").alias("na"), F.col("cells").alias("ca"), F.explode(ids).alias("j"))
    b = panel.blocks.select(F.col("block").alias("j"), F.col("names").alias("nb"), F.col("cells").alias("cb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                na, nb = batch.column("na")[row].as_py(), batch.column("nb")[row].as_py()
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer()).reshape(n, -1) for c in ("ca", "cb"))
                value = (x - x.mean(0)).T @ (y - y.mean(0)) / (n - 1) if n > 1 else np.full((len(na), len(nb)), np.nan)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(na, len(nb))), pa.array(nb * len(na)), pa.array(value.reshape(-1))], ["col_a", "col_b", "value"])

    return a.join(b, "j").mapInArrow(work, "col_a string, col_b string, value double")


@dataclass(frozen=True)
class Factors:
    panel: Panel
    eigenvalues: np.ndarray  # descending, as many as there are columns or dates, whichever are fewer
    directions: np.ndarray = field(repr=False)  # T x k: centred rows times these are loadings

    def shares(self, spark: SparkSession) -> DataFrame:
        """Eigenvalue and share of the total variance per component."""
        total = float(self.eigenvalues.sum())
        return spark.createDataFrame([(i + 1, float(v), float(v) / total) for i, v in enumerate(self.eigenvalues)], "component int, eigenvalue double, share double")

    def loadings(self) -> DataFrame:
        """``column``, ``component``, ``loading``; each vector's largest entry is positive."""
        directions = self.directions

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, x in _matrices(batches):
                line = (x - x.mean(0)).T @ directions
                k = line.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1), len(names)).astype(np.int32)), pa.array(line.reshape(-1))],
                    ["column", "component", "loading"],
                )

        return self.panel.blocks.mapInArrow(work, "column string, component int, loading double")

    def scores(self, spark: SparkSession, date: str = "date") -> DataFrame:
        """``date``, ``pc1`` ...: the un-centred rows on the components."""
        panel, directions, n = self.panel, self.directions, len(self.panel.dates)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, directions.shape[1]))
            for _, x in _matrices(batches):
                total += x @ ((x - x.mean(0)).T @ directions)
            yield from emit(0, total.reshape(-1), 1)

        total = summed(panel.blocks, work)[0][0].reshape(len(panel.dates), -1)
        names = ", ".join(f"pc{i + 1} double" for i in range(total.shape[1]))
        kind = "date" if not isinstance(panel.dates[0], (int, str)) else "string" if isinstance(panel.dates[0], str) else "long"
        return spark.createDataFrame([(d, *map(float, line)) for d, line in zip(panel.dates, total)], f"{date} {kind}, {names}")

    def checks(self) -> tuple[float, float]:
        """Trace of the covariance, and the greatest |Cv - lambda v| over components, relative to the first eigenvalue."""
        panel, directions = self.panel, self.directions
        n, k = len(panel.dates), directions.shape[1]

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, trace = np.zeros((n, k)), 0.0
            for _, x in _matrices(batches):
                c = x - x.mean(0)
                total += c @ (c.T @ directions)
                trace += float((c * c).sum()) / (n - 1)
            yield from emit(0, np.append(total.reshape(-1), trace), 1)

        total = summed(panel.blocks, products)[0][0]
        trace, image = float(total[-1]), total[:-1].reshape(n, k)
        values = self.eigenvalues[:k]

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            square = np.zeros(k)
            for _, x in _matrices(batches):
                c = x - x.mean(0)
                square += ((c.T @ image / (n - 1) - (c.T @ directions) * values) ** 2).sum(axis=0)
            yield from emit(0, square, 1)

        off = np.sqrt(summed(panel.blocks, residuals)[0][0])
        return trace, float(off.max() / max(values[0], 1e-300))


def panel_factors(rows: DataFrame, key: str, date: str, value: str, k: int = 3) -> Factors:
    """Components of the sample covariance of a complete long panel. Needs two dates or more."""
    panel = panel_blocks(rows, key, date, value)
    n = len(panel.dates)
    if n < 2:
        raise ValueError("components need two dates or more")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, columns = np.zeros((n, n)), 0
        for names, x in _matrices(batches):
            c = x - x.mean(0)
            total += c @ c.T
            columns += len(names)
        yield from emit(0, total.reshape(-1), columns)

    total, columns = summed(panel.blocks, work)[0]
    values, vectors = np.linalg.eigh(total.reshape(n, n) / (n - 1))
    order = np.argsort(values)[::-1][: min(n, columns)]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    k = min(k, int((values > values[0] * 1e-12).sum()) if len(values) and values[0] > 0 else 0)
    directions = vectors[:, :k] / np.sqrt(values[:k] * (n - 1))
    found = Factors(panel, values, directions)
    if not k:
        return found
    largest = found.loadings().groupBy("component").agg(F.max_by("loading", F.struct(F.abs("loading"), "column")).alias("l"))
    signs = np.ones(k)
    for component, loading in largest.collect():  # a row for each kept component
        signs[component - 1] = -1.0 if loading < 0 else 1.0
    return Factors(panel, values, directions * signs)
