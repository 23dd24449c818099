"""Matrix patterns (J3, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.catalogue.registry import register
from tallygrove.operators import patterns as pt
from tallygrove.plans.fixtures import purchase_cells

# an asymmetric pattern: turning it by 180 degrees changes it
KERNEL = [[1, 0, 0], [0, 1, 0], [0, 1, 0]]

CELLS = """
  WITH u AS (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS row_idx FROM (SELECT DISTINCT user_id FROM events)),
  h AS (SELECT unnest(range(24)) AS col_idx),
  e AS (SELECT DISTINCT user_id, hour(ts) AS h FROM events WHERE event_type = 'purchase'),
  cells AS (SELECT u.row_idx AS row_idx, CAST(h.col_idx AS INTEGER) AS col_idx, CAST(e.h IS NOT NULL AS INTEGER)::DOUBLE AS value
            FROM u CROSS JOIN h LEFT JOIN e ON e.user_id = u.user_id AND e.h = h.col_idx),
  k AS (SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.0),
                              (2, 0, 0.0), (2, 1, 1.0), (2, 2, 0.0)) t(a, b, w)),
  pos AS (SELECT row_idx, col_idx FROM cells
          WHERE row_idx <= (SELECT max(row_idx) FROM cells) - 2 AND col_idx <= 21),
  conv AS (SELECT pos.row_idx, pos.col_idx, sum(c.value * k.w) AS value FROM pos, k, cells c
           WHERE c.row_idx = pos.row_idx + 2 - k.a AND c.col_idx = pos.col_idx + 2 - k.b GROUP BY 1, 2),
  cosine AS (SELECT pos.row_idx, pos.col_idx,
               CASE WHEN sum(c.value * c.value) = 0 THEN 0.0
                    ELSE sum(c.value * k.w) / (sqrt(3.0) * sqrt(sum(c.value * c.value))) END AS score
             FROM pos, k, cells c WHERE c.row_idx = pos.row_idx + k.a AND c.col_idx = pos.col_idx + k.b GROUP BY 1, 2),
  by_sum AS (SELECT row_idx, col_idx FROM conv WHERE value = 3),
  exact AS (SELECT row_idx, col_idx FROM cosine WHERE abs(score - 1) <= 1e-8 + 1e-5)"""


def _int(table: str, more: str = "") -> str:
    return f"{CELLS} SELECT CAST(row_idx AS INTEGER) AS row_idx, CAST(col_idx AS INTEGER) AS col_idx{more} FROM {table}"


def _typed(df):
    return df.withColumns({c: F.col(c).cast("int") for c in ("row_idx", "col_idx")})


def _cells(spark, folder):
    return _typed(purchase_cells(spark, folder))


@register("s7_purchase_matrix", _int("cells", ", value"))
def _(spark, folder):
    return _cells(spark, folder)


@register(
    "j3_kernel_join",
    f"""{CELLS} SELECT CAST(pos.row_idx AS INTEGER) AS row_idx, CAST(pos.col_idx AS INTEGER) AS col_idx,
        c.value AS value, k.w AS weight FROM pos, k, cells c
        WHERE c.row_idx = pos.row_idx + k.a AND c.col_idx = pos.col_idx + k.b""",
)
def _(spark, folder):
    return pt.kernel_join(_cells(spark, folder), KERNEL, rotate=False, tile=16).drop("tile_i", "tile_j")


@register("m1_convolve2d_valid", _int("conv", ", value"))
def _(spark, folder):
    return pt.convolve2d_valid(_cells(spark, folder), KERNEL)


@register("m2_match_by_sum", _int("by_sum"))
def _(spark, folder):
    return pt.match_by_sum(pt.convolve2d_valid(_cells(spark, folder), KERNEL), KERNEL)


@register(
    "m3_highlight",
    f"""{CELLS}, hit AS (SELECT row_idx + a AS r, col_idx + b AS c, count(*) AS n FROM by_sum, k GROUP BY 1, 2)
        SELECT CAST(row_idx AS INTEGER) AS row_idx, col_idx, value + 4 * coalesce(n, 0) AS value
        FROM cells LEFT JOIN hit ON r = row_idx AND c = col_idx""",
)
def _(spark, folder):
    cells = _cells(spark, folder)
    return pt.highlight(cells, pt.match_by_sum(pt.convolve2d_valid(cells, KERNEL), KERNEL), KERNEL)


@register("m4_cosine_scores", _int("cosine", ", round(score, 6) + 0.0 AS score"))
def _(spark, folder):
    return pt.cosine_scores(_cells(spark, folder), KERNEL)


@register("m4_match_by_cosine", _int("exact"))
def _(spark, folder):
    return pt.match_by_cosine(_cells(spark, folder), KERNEL)


@register(
    "m5_matched_cells",
    f"""{CELLS}, hit AS (SELECT DISTINCT row_idx + a AS r, col_idx + b AS c FROM exact, k)
        SELECT CAST(row_idx AS INTEGER) AS row_idx, col_idx, value, CAST(r IS NOT NULL AS INTEGER) AS matched
        FROM cells LEFT JOIN hit ON r = row_idx AND c = col_idx""",
)
def _(spark, folder):
    cells = _cells(spark, folder)
    return pt.matched_cells(cells, pt.match_by_cosine(cells, KERNEL), KERNEL)
