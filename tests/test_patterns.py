import numpy as np
import pytest

from tallygrove.operators import patterns as pt

KERNEL = [[1, 0], [0, 2], [3, 0]]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(0, 2, size=(23, 17)).astype(float)
    m[5:8, 4:6] = np.array(KERNEL)
    cells = [(i, j, float(m[i, j])) for i in range(23) for j in range(17)]
    return spark.createDataFrame(cells, "row_idx int, col_idx int, value double").repartition(5), m


def grid(df, name="value"):
    return {(r.row_idx, r.col_idx): r[name] for r in df.collect()}


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_convolution(matrix, tile):
    cells, m = matrix
    k = np.array(KERNEL)
    got = grid(pt.convolve2d_valid(cells, KERNEL, tile))
    assert len(got) == 21 * 16
    for (i, j), v in got.items():
        assert v == (m[i : i + 3, j : j + 2] * k[::-1, ::-1]).sum()


@pytest.mark.parametrize("tile", [2, 256])
def test_cosine_and_cells(matrix, tile):
    cells, m = matrix
    k = np.array(KERNEL)
    got = grid(pt.cosine_scores(cells, KERNEL, tile), "score")
    for (i, j), v in got.items():
        w = m[i : i + 3, j : j + 2]
        norm = np.linalg.norm(k) * np.linalg.norm(w)
        assert v == pytest.approx((w * k).sum() / norm if norm else 0.0)
    matches = pt.match_by_cosine(cells, KERNEL, tile)
    assert (5, 4) in {(r.row_idx, r.col_idx) for r in matches.collect()}
    flagged = grid(pt.matched_cells(cells, matches, KERNEL), "matched")
    assert len(flagged) == m.size and flagged[5, 4] == flagged[7, 5] == 1


def test_overlapping_highlights_add_up(spark):
    cells = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3)], "row_idx int, col_idx int, value double")
    ones = [[1, 1], [1, 1]]
    matches = pt.match_by_sum(pt.convolve2d_valid(cells, ones), ones)
    lit = grid(pt.highlight(cells, matches, ones))
    assert lit[1, 1] == 17.0 and lit[0, 0] == 5.0 and lit[0, 1] == 9.0


def test_kernel_limits(spark, matrix):
    cells, _ = matrix
    assert pt.kernel_from_cells(cells.where("row_idx < 2 and col_idx < 2"))[1][1] == matrix[1][1, 1]
    with pytest.raises(ValueError):
        pt.kernel_from_cells(cells, max_cells=10)
    with pytest.raises(ValueError):
        pt.convolve2d_valid(cells, [[1] * 18])


def test_one_shuffle(matrix):
    plan = pt.convolve2d_valid(matrix[0], KERNEL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan


@pytest.mark.parametrize("tile", [50, 256])
def test_large_patterns(spark, tile, monkeypatch):
    rng = np.random.default_rng(6)
    m, k = rng.integers(0, 3, size=(90, 110)).astype(float), rng.integers(0, 2, size=(64, 64)).astype(float)
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(90) for j in range(110)], "row_idx int, col_idx int, value double").repartition(4)
    want = {(i, j): (m[i : i + 64, j : j + 64] * k[::-1, ::-1]).sum() for i in range(27) for j in range(47)}
    assert grid(pt.convolve2d_valid(cells, k.tolist(), tile)) == want  # by transform
    monkeypatch.setattr(pt, "TRANSFORM", 1 << 30)
    assert grid(pt.convolve2d_valid(cells, k.tolist(), tile)) == want
    half = pt.convolve2d_valid(cells.selectExpr("row_idx", "col_idx", "value / 3 AS value"), k.tolist(), tile)
    assert grid(half) == pytest.approx({p: v / 3 for p, v in want.items()})


def test_missing_cells_and_values(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (5, 5, 2.0), (9, 9, None)], "row_idx int, col_idx int, value double")
    got = grid(pt.convolve2d_valid(cells, [[1, 2], [3, 4]], 4))
    assert got[0, 0] == 8.0 and {p: v for p, v in got.items() if v} == {(0, 0): 8.0, (4, 4): 2.0, (4, 5): 4.0, (5, 4): 6.0, (5, 5): 8.0}
