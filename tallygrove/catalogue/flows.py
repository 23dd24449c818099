"""End-to-end flows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.catalogue.models import descent_sql
from tallygrove.catalogue.patterns import CELLS, KERNEL
from tallygrove.catalogue.registry import register
from tallygrove.operators import patterns as pt
from tallygrove.plans import credit, housing, market
from tallygrove.plans import fixtures as fx


@register("flow_credit_metrics")
def _(spark, folder):
    return credit.run(fx.loans(spark, folder)).tables["metrics"]


@register("flow_credit_network")
def _(spark, folder):
    return credit.run_network(fx.loans(spark, folder))


@register("flow_housing_models")
def _(spark, folder):
    table, features = housing.prepare(fx.iowa(spark, folder))
    n = table.count()
    return housing.compare(housing.split_and_scale(table, features, int(0.6 * n), int(0.2 * n)))


@register("flow_housing_strongest")
def _(spark, folder):
    table, features = housing.prepare(fx.iowa(spark, folder))
    n = table.count()
    return housing.strongest(housing.split_and_scale(table, features, int(0.6 * n), int(0.2 * n)), 0.3)


@register("flow_return_factors")
def _(spark, folder):
    prices = fx.price_panel(spark, folder).withColumnRenamed("month", "date")
    return market.return_factors(prices).projection


@register("flow_equity_clusters")
def _(spark, folder):
    raw = fx.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "--").otherwise(F.col("c_acctbal").cast("string")).alias("peg"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(".5")).alias("cap"),
    )
    return market.cluster_equities(market.clean_equities(raw))[0]


@register(
    "flow_run_regression",
    descent_sql(["1.0", "q", "d"], 0.1, 100_000, 1e-7, ["intercept", "q", "d"]),
    "feature coefficient~",
    digits=4,
)
def _(spark, folder):
    table = fx.line_regression(spark, folder).select("q", "d", F.col("y").alias("target"))
    return market.run_regression(table, "target", 0.1)


@register(
    "flow_pattern_detection",
    f"""{CELLS}, a AS (SELECT row_idx + a AS r, col_idx + b AS c, count(*) AS n FROM by_sum, k GROUP BY 1, 2),
        x AS (SELECT DISTINCT row_idx + a AS r, col_idx + b AS c FROM exact, k)
        SELECT row_idx, col_idx, value + 4 * coalesce(n, 0) AS value, CAST(x.r IS NOT NULL AS INTEGER) AS matched
        FROM cells LEFT JOIN a ON a.r = row_idx AND a.c = col_idx LEFT JOIN x ON x.r = row_idx AND x.c = col_idx""",
)
def _(spark, folder):
    cells, kernel = fx.purchase_cells(spark, folder), KERNEL
    lit = pt.highlight(cells, pt.match_by_sum(pt.convolve2d_valid(cells, kernel), kernel), kernel)
    flagged = pt.matched_cells(cells, pt.match_by_cosine(cells, kernel), kernel).drop("value")
    return lit.join(flagged, ["row_idx", "col_idx"])


LOAN_FEATURES = """
  WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, max(l_discount) AS disc, max(l_tax) AS tax,
               count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'F') AS closed
             FROM lineitem GROUP BY l_orderkey),
  j AS (SELECT *, CASE WHEN returned > 0 THEN qty END AS delinq, CASE WHEN closed > 1 THEN qty * 2 END AS record,
               CASE WHEN returned > 1 THEN qty + 12 END AS derog
        FROM orders LEFT JOIN l ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
        WHERE (o_orderpriority <> '5-LOW' OR n > 0) AND o_orderkey % 10 NOT IN (3, 7))
  SELECT o_orderkey AS id,
    CAST(o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_totalprice > 350000) AS INTEGER) AS label,
    round(coalesce(disc, 0.0) * 100) AS int_rate, round(coalesce(tax, 0.0) * 100) AS revol_util,
    o_totalprice * 0.98::DOUBLE AS funded_amnt_inv, o_totalprice / 36 AS installment, c_acctbal * 10 + 20000 AS annual_inc,
    o_totalprice / 30000 AS dti, greatest(c_acctbal, 0.0) AS revol_bal,
    CASE WHEN returned > 0 THEN qty ELSE 0.0 END AS tot_coll_amt, c_acctbal AS tot_cur_bal,
    CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 ELSE 0.0 END AS total_rev_hi_lim,
    coalesce(returned, 0)::DOUBLE AS delinq_2yrs, coalesce(n, 0)::DOUBLE AS inq_last_6mths, coalesce(n, 0)::DOUBLE AS open_acc,
    coalesce(closed, 0)::DOUBLE AS pub_rec, coalesce(qty, 0.0) AS total_acc, 0.0::DOUBLE AS collections_12_mths_ex_med,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 0.0::DOUBLE ELSE 1.0 END AS acc_now_delinq,
    CAST(delinq IS NOT NULL AS INTEGER) AS ever_delinq, CAST(coalesce(delinq <= 24, false) AS INTEGER) AS delinq_24m,
    CAST(derog IS NOT NULL AS INTEGER) AS ever_major_derog, CAST(coalesce(derog <= 60, false) AS INTEGER) AS derog_60m,
    CAST(record IS NOT NULL AS INTEGER) AS ever_public_record, CAST(coalesce(record <= 60, false) AS INTEGER) AS record_60m,
    coalesce(1 / (1 + delinq), 0.0) AS delinq_recency_score, coalesce(1 / (1 + derog), 0.0) AS derog_recency_score,
    coalesce(1 / (1 + record), 0.0) AS record_recency_score, (c_nationkey + 1)::DOUBLE AS credit_age,
    c_mktsegment AS purpose, CASE WHEN n > 3 THEN 'f' ELSE 'w' END AS initial_list_status,
    substr(o_orderpriority, 1, 1) AS grade, substr(o_orderpriority, 1, 1) || (c_nationkey % 5) AS sub_grade,
    CASE WHEN c_acctbal > 5000 THEN 'OWN' WHEN c_acctbal > 0 THEN 'MORTGAGE' END AS home_ownership,
    CASE WHEN returned > 0 THEN 'Verified' ELSE 'Not Verified' END AS verification_status,
    CAST(c_nationkey AS VARCHAR) AS addr_state, 'INDIVIDUAL' AS application_type FROM j"""
ROUNDED = (
    "funded_amnt_inv installment annual_inc dti revol_bal tot_coll_amt tot_cur_bal total_rev_hi_lim delinq_2yrs "
    "inq_last_6mths open_acc pub_rec total_acc collections_12_mths_ex_med acc_now_delinq delinq_recency_score "
    "derog_recency_score record_recency_score credit_age int_rate revol_util"
)
EXACT = (
    "id label ever_delinq delinq_24m ever_major_derog derog_60m ever_public_record record_60m purpose initial_list_status "
    "grade sub_grade home_ownership verification_status addr_state application_type"
)


@register("flow_credit_features", LOAN_FEATURES, " ".join([EXACT, *[f"{c}~" for c in ROUNDED.split()]]))
def _(spark, folder):
    return credit.engineer(fx.loans(spark, folder))
