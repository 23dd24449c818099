"""Two-dimensional pattern matching on a matrix held as cells ``(row_idx, col_idx, value)``.

The matrix is cut into square tiles of output positions. A cell is sent to the tiles it takes part
in (one, or up to four at the borders); there the tile and its border become one array, which is
multiplied with the pattern in numpy: one shuffle of little more than the cells, and no row for each
pair of a cell and a weight. A tile holds a bounded number of cells, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
TRANSFORM = 1024  # cells of a pattern beyond which whole numbers are multiplied by transform, which rounding makes exact
Kernel = Sequence[Sequence[float]]


def kernel_from_cells(cells: DataFrame, max_cells: int = 1 << 20) -> list[list[float]]:
    """A pattern kept as cells -> rows of numbers; its size is checked, since every task gets a copy."""
    rows = cells.limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        raise ValueError(f"a pattern may have at most {max_cells} cells")
    r, c = max(x.row_idx for x in rows) + 1, max(x.col_idx for x in rows) + 1
    out = [[0.0] * c for _ in range(r)]
    for x in rows:
        out[x.row_idx][x.col_idx] = float(x.value)
    return out


def _tile_range(at: Column, span: int, last: Column | int, tile: int) -> Column:
    """Tiles of the output positions ``at - span + 1 .. at`` that exist."""
    lo = F.greatest(at - (span - 1), F.lit(0))
    hi = F.least(at, F.lit(last))
    def whole(c: Column) -> Column:
        return F.floor(c / F.lit(tile)).cast("int")
    return F.when(lo <= hi, F.sequence(whole(lo), whole(hi))).otherwise(F.array().cast("array<int>"))


def kernel_join(cells: DataFrame, kernel: Kernel, rotate: bool, tile: int = TILE) -> DataFrame:
    """Every (cell, pattern offset) pair that falls on a valid output position.

    Columns: tile, output position, cell value, weight. With ``rotate`` the pattern is turned by
    180 degrees, as in a true convolution.
    """
    r, c = len(kernel), len(kernel[0])
    size = cells.agg(F.max("row_idx").alias("r"), F.max("col_idx").alias("c")).first()
    last_r, last_c = size.r + 1 - r, size.c + 1 - c
    if last_r < 0 or last_c < 0:
        raise ValueError("the pattern is larger than the matrix")
    offsets = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.lit(float(kernel[r - 1 - a][c - 1 - b] if rotate else kernel[a][b])).alias("w"),
            )
            for a in range(r)
            for b in range(c)
        ]
    )
    i, j = F.col("row_idx").cast("int"), F.col("col_idx").cast("int")
    tiled = (
        cells.select(i.alias("i"), j.alias("j"), F.col("value").cast("double").alias("value"))
        .withColumn("tile_i", F.explode(_tile_range(F.col("i"), r, last_r, tile)))
        .withColumn("tile_j", F.explode(_tile_range(F.col("j"), c, last_c, tile)))
        .repartition("tile_i", "tile_j")
    )
    out_i, out_j = F.col("i") - F.col("o.a"), F.col("j") - F.col("o.b")
    return (
        tiled.withColumn("o", F.explode(offsets))
        .select("tile_i", "tile_j", out_i.alias("row_idx"), out_j.alias("col_idx"), "value", F.col("o.w").alias("weight"))
        .where(F.col("row_idx").between(0, last_r) & F.col("col_idx").between(0, last_c))
        .where(
            (F.floor(F.col("row_idx") / F.lit(tile)) == F.col("tile_i"))
            & (F.floor(F.col("col_idx") / F.lit(tile)) == F.col("tile_j"))
        )
    )


def _weighted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the window's cells times the weights, at every position where the window lies inside."""
    rows, cols = x.shape[0] - w.shape[0] + 1, x.shape[1] - w.shape[1] + 1
    whole = w.size > TRANSFORM and np.array_equal(x, np.rint(x)) and np.array_equal(w, np.rint(w))
    if whole and np.abs(x).max(initial=0) * np.abs(w).sum() < 2**40:
        shape = tuple(1 << (n - 1).bit_length() for n in x.shape)
        return np.rint(np.fft.irfft2(np.fft.rfft2(x, shape) * np.conj(np.fft.rfft2(w, shape)), shape))[:rows, :cols]
    out = np.zeros((rows, cols))
    for a, b in zip(*np.nonzero(w)):
        out += w[a, b] * x[a : a + rows, b : b + cols]
    return out


def _boxes(x: np.ndarray, r: int, c: int) -> np.ndarray:
    """Sum of every window of r times c cells."""
    rows, cols = x.shape[0] - r + 1, x.shape[1] - c + 1
    lines = sum(x[a : a + rows] for a in range(r))
    return sum(lines[:, b : b + cols] for b in range(c))


def _windows(cells: DataFrame, kernel: Kernel, rotate: bool, tile: int) -> DataFrame:
    """``row_idx``, ``col_idx``, ``dot`` (cells times weights), ``sq`` (squared cells) of every window that holds a cell.

    A missing cell or value counts as 0, cells of one place add up. With ``rotate`` the pattern is turned by 180 degrees, as
    in a true convolution.
    """
    weights = np.array(kernel, np.float64)
    weights = weights[::-1, ::-1].copy() if rotate else weights
    r, c = weights.shape
    size = cells.agg(F.max("row_idx").alias("r"), F.max("col_idx").alias("c")).first()
    last_r, last_c = size.r + 1 - r, size.c + 1 - c
    if last_r < 0 or last_c < 0:
        raise ValueError("the pattern is larger than the matrix")

    def work(key: tuple, table: pa.Table) -> pa.Table:
        low_i, low_j = (k.as_py() * tile for k in key)
        rows, cols = min(tile, last_r + 1 - low_i), min(tile, last_c + 1 - low_j)
        i, j = table.column("i").to_numpy() - low_i, table.column("j").to_numpy() - low_j
        v = np.nan_to_num(table.column("value").to_numpy(zero_copy_only=False).astype(np.float64))
        x, square, there = (np.zeros((rows + r - 1, cols + c - 1)) for _ in range(3))
        np.add.at(x, (i, j), v)
        np.add.at(square, (i, j), v * v)
        there[i, j] = 1
        at = np.nonzero(_boxes(there, r, c))
        columns = [(at[0] + low_i).astype(np.int32), (at[1] + low_j).astype(np.int32), _weighted(x, weights)[at], _boxes(square, r, c)[at]]
        return pa.table(dict(zip(("row_idx", "col_idx", "dot", "sq"), columns)))

    i, j = F.col("row_idx").cast("int"), F.col("col_idx").cast("int")
    tiled = (
        cells.select(i.alias("i"), j.alias("j"), F.col("value").cast("double").alias("value"))
        .withColumn("tile_i", F.explode(_tile_range(F.col("i"), r, last_r, tile)))
        .withColumn("tile_j", F.explode(_tile_range(F.col("j"), c, last_c, tile)))
    )
    return tiled.groupBy("tile_i", "tile_j").applyInArrow(work, "row_idx int, col_idx int, dot double, sq double")


def convolve2d_valid(cells: DataFrame, kernel: Kernel, tile: int = TILE) -> DataFrame:
    """True convolution over all positions where the pattern lies inside the matrix."""
    return _windows(cells, kernel, True, tile).select("row_idx", "col_idx", F.col("dot").alias("value"))


def match_by_sum(convolved: DataFrame, kernel: Kernel) -> DataFrame:
    """Positions whose result equals the pattern's sum; sound for 0/1 data only."""
    return convolved.where(F.col("value") == F.lit(float(sum(map(sum, kernel))))).select("row_idx", "col_idx")


def cosine_scores(cells: DataFrame, kernel: Kernel, tile: int = TILE) -> DataFrame:
    """Cosine of the un-rotated pattern and each window; 0 where either is all zero."""
    norm = sum(v * v for row in kernel for v in row) ** 0.5
    sums = _windows(cells, kernel, False, tile)
    divisor = F.lit(norm) * F.sqrt("sq")
    return sums.select("row_idx", "col_idx", F.when(divisor != 0, F.col("dot") / divisor).otherwise(0.0).alias("score"))


def match_by_cosine(cells: DataFrame, kernel: Kernel, tile: int = TILE) -> DataFrame:
    """Positions whose score is 1 within 1e-8 + 1e-5."""
    near = F.abs(F.col("score") - 1) <= F.lit(1e-8 + 1e-5)
    return cosine_scores(cells, kernel, tile).where(near).select("row_idx", "col_idx")


def _covered(matches: DataFrame, kernel: Kernel) -> DataFrame:
    """One row per (match, cell under it)."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(len(kernel) - 1)))
    cols = F.explode(F.sequence(F.lit(0), F.lit(len(kernel[0]) - 1)))
    return (
        matches.select("row_idx", "col_idx", rows.alias("a"))
        .select("row_idx", "col_idx", "a", cols.alias("b"))
        .select((F.col("row_idx") + F.col("a")).alias("row_idx"), (F.col("col_idx") + F.col("b")).alias("col_idx"))
    )


def highlight(cells: DataFrame, matches: DataFrame, kernel: Kernel, add: float = 4.0) -> DataFrame:
    """Add ``add`` to a cell for every match that covers it."""
    hits = _covered(matches, kernel).groupBy("row_idx", "col_idx").agg(F.count(F.lit(1)).alias("_hits"))
    return cells.join(hits, ["row_idx", "col_idx"], "left").select(
        "row_idx", "col_idx", (F.col("value") + F.lit(add) * F.coalesce("_hits", F.lit(0))).alias("value")
    )


def matched_cells(cells: DataFrame, matches: DataFrame, kernel: Kernel) -> DataFrame:
    """Flag the cells under any match."""
    under = _covered(matches, kernel).distinct().withColumn("_hit", F.lit(1))
    return cells.join(under, ["row_idx", "col_idx"], "left").select(
        "row_idx", "col_idx", "value", F.coalesce("_hit", F.lit(0)).alias("matched")
    )
