"""Views over the TPC-H-like tables that stand in for the loan, house, equity and price inputs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.scalars import floor_log, ordinal_encode, signed_log
from tallygrove.operators.splits import split_stratified
from tallygrove.session import shared_folder
from tallygrove.sources.tables import read_table, with_positions

TASK_ROWS = 1 << 18  # rows of each side that a task of a large join sorts
SMALL_PARTS = 4  # tables of no more than so many times these rows are left to the planner


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", "parquet")


def dealt(tables: Sequence[DataFrame], key: str, rows: int) -> list[DataFrame]:
    """Large tables dealt by the key on which they are joined next, in partitions of about ``TASK_ROWS`` of their ``rows``.

    A task of the join then sorts as many rows whatever the size of the tables and the session's number of partitions.
    """
    parts = math.ceil(rows / TASK_ROWS)
    return list(tables) if parts <= SMALL_PARTS else [df.repartition(parts, key) for df in tables]


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scored loans: id, label, p in 0..1."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    bad = (status == "F") | ((status == "P") & (price > 350000))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        bad.cast("int").alias("label"),
        (price / (price + F.lit(250000.0))).alias("p"),
    )


def scored_split(spark: SparkSession, folder: str, seed: int = 42) -> DataFrame:
    return split_stratified(scored(spark, folder), seed)


def price_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly mean unit price per brand: (month, ticker, price).

    Line items are summed per part and month before they meet the parts. The panel is small and the
    panel operators read it several times, so it is written once.
    """
    shared_folder(spark)
    line = table(spark, folder, "lineitem")
    per_part = line.groupBy("l_partkey", F.trunc("l_shipdate", "month").alias("month")).agg(
        F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return (
        per_part.join(part, "l_partkey")
        .groupBy("month", "ticker")
        .agg((F.sum("s") / F.sum("n")).alias("price"))
        .checkpoint()
    )


def purchase_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Users x hours, 1 where the user bought in that hour: dense 0/1 cells."""
    events = table(spark, folder, "events")
    hours = events.groupBy("user_id").agg(
        *[
            F.max(((F.col("event_type") == "purchase") & (F.hour("ts") == h)).cast("int")).alias(f"h{h}")
            for h in range(24)
        ]
    )
    cells = F.posexplode(F.array(*[F.col(f"h{h}") for h in range(24)])).alias("col_idx", "value")
    placed = with_positions(hours, "user_id")
    return placed.select("row_idx", cells).select("row_idx", "col_idx", F.col("value").cast("double").alias("value"))


def line_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a regression table: q, d, t in about 0..1, price in thousands."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_quantity") / 50).alias("q"),
        (F.col("l_discount") * 10).alias("d"),
        (F.col("l_tax") * 10).alias("t"),
        (F.col("l_extendedprice") / 1000).alias("y"),
    )


def equities(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as equities: logs of the balance and of the total ordered."""
    spent = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    both = table(spark, folder, "customer").select("c_custkey", "c_acctbal").join(spent, "c_custkey", "left")
    return both.select(
        F.col("c_custkey").alias("id"),
        signed_log(F.coalesce("c_acctbal", F.lit(0.0))).alias("style"),
        floor_log(F.coalesce("spent", F.lit(0.0))).alias("size"),
    )


# fixed order of the part types, for the ordinal column
LEVELS = {"ECONOMY": 1, "SMALL": 2, "STANDARD": 3, "MEDIUM": 4, "LARGE": 5, "PROMO": 6}


def houses(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as houses: mean unit price sold (label), size, ordinal level, nominal brand."""
    sold = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("sold"),
        F.avg("l_quantity").alias("mean_quantity"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("label"),
    )
    return table(spark, folder, "part").join(sold, "p_partkey").select(
        F.col("p_partkey").alias("id"),
        (F.col("label") / 100).alias("label"),
        F.col("p_size").cast("double").alias("size"),
        F.coalesce(ordinal_encode("p_type", LEVELS), F.lit(0)).cast("double").alias("level"),
        (F.col("p_retailprice") / 1000).alias("list_price"),
        F.col("sold").cast("double").alias("sold"),
        "mean_quantity",
        F.col("p_brand").alias("brand"),
    )


def loans(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, their lines and customers in the columns of a loan table; a fifth have no usable ``revol_util``."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.max("l_discount").alias("disc"),
        F.max("l_tax").alias("tax"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_linestatus") == "F").alias("closed"),
    )
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey", "c_mktsegment")
    all_of = table(spark, folder, "orders").join(lines, "o_orderkey", "left").join(customers, "o_custkey")
    c = F.col
    bad = (c("o_orderstatus") == "F") | ((c("o_orderstatus") == "P") & (c("o_totalprice") > 350000))
    n = F.coalesce("n", F.lit(0)).cast("double")
    return all_of.select(
        c("o_orderkey").alias("id"),
        c("o_totalprice").alias("loan_amnt"),
        c("o_totalprice").alias("funded_amnt"),
        (c("o_totalprice") * 0.98).alias("funded_amnt_inv"),
        (c("o_totalprice") / 36).alias("installment"),
        (c("c_acctbal") * 10 + 20000).alias("annual_inc"),
        (c("o_totalprice") / 30000).alias("dti"),
        F.concat(F.round(F.coalesce("disc", F.lit(0.0)) * 100).cast("string"), F.lit("%")).alias("int_rate"),
        F.when(c("o_orderkey") % 10 == 7, F.lit("n/a"))
        .when(c("o_orderkey") % 10 != 3, F.concat(F.round(F.coalesce("tax", F.lit(0.0)) * 100).cast("string"), F.lit(" %")))
        .alias("revol_util"),
        F.lit(" 36 months").alias("term"),
        F.lit("10+ years").alias("emp_length"),
        F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
        F.date_format(F.add_months("o_orderdate", -12 * (c("c_nationkey") + 1)), "MMM-yyyy").alias("earliest_cr_line"),
        c("c_mktsegment").alias("purpose"),
        F.when(c("n") > 3, "f").otherwise("w").alias("initial_list_status"),
        F.substring("o_orderpriority", 1, 1).alias("grade"),
        F.concat(F.substring("o_orderpriority", 1, 1), (c("c_nationkey") % 5).cast("string")).alias("sub_grade"),
        F.when(c("c_acctbal") > 5000, "OWN").when(c("c_acctbal") > 0, "MORTGAGE").alias("home_ownership"),
        F.when(c("returned") > 0, "Verified").otherwise("Not Verified").alias("verification_status"),
        c("c_nationkey").cast("string").alias("addr_state"),
        F.lit("INDIVIDUAL").alias("application_type"),
        F.coalesce("returned", F.lit(0)).cast("double").alias("delinq_2yrs"),
        n.alias("inq_last_6mths"),
        n.alias("open_acc"),
        F.coalesce("closed", F.lit(0)).cast("double").alias("pub_rec"),
        F.coalesce("qty", F.lit(0.0)).alias("total_acc"),
        F.lit(0.0).alias("collections_12_mths_ex_med"),
        F.when(c("o_orderpriority") != "5-LOW", F.lit(0.0)).otherwise(F.when(c("n") > 0, F.lit(1.0))).alias("acc_now_delinq"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("revol_bal"),
        F.when(c("returned") > 0, c("qty")).alias("tot_coll_amt"),
        c("c_acctbal").alias("tot_cur_bal"),
        F.when(c("c_acctbal") > 0, c("c_acctbal") * 2).alias("total_rev_hi_lim"),
        F.when(c("returned") > 0, c("qty")).alias("mths_since_last_delinq"),
        F.when(c("closed") > 1, c("qty") * 2).alias("mths_since_last_record"),
        F.when(c("returned") > 1, c("qty") + 12).alias("mths_since_last_major_derog"),
        F.when(bad, "Charged Off").when(c("o_orderstatus") == "O", "Fully Paid").otherwise("Current").alias("loan_status"),
    )


def iowa(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and their sales in the columns of a house table."""
    sold = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.avg("l_quantity").alias("mean_qty"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
        F.max("l_linenumber").cast("double").alias("last_line"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returned"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )
    c = F.col
    grade = F.when(c("p_type") == "ECONOMY", "Po").when(c("p_type") == "SMALL", "Fa").when(c("p_type") == "STANDARD", "TA")
    return table(spark, folder, "part").join(sold, "p_partkey").select(
        c("p_partkey").alias("id"),
        (c("qty") * 10).alias("lot_area"),
        (c("p_size") % 10 + 1).cast("double").alias("overall_qual"),
        c("last_line").alias("overall_cond"),
        (c("p_size") + 1950).cast("double").alias("year_built"),
        (c("p_size") + 1960 + c("last_line")).alias("year_remod_add"),
        F.when(c("last_line") > 3, c("qty")).alias("bsmt_fin_sf1"),
        c("returned").alias("bsmt_fin_sf2"),
        (c("mean_qty") * 2).alias("bsmt_unf_sf"),
        (c("qty") + c("mean_qty")).alias("total_bsmt_sf"),
        c("p_retailprice").alias("first_flr_sf"),
        (c("p_retailprice") * c("disc")).alias("second_flr_sf"),
        (c("p_retailprice") * (1 + c("disc"))).alias("gr_liv_area"),
        (c("n") % 3).alias("full_bath"),
        (c("n") % 2).alias("half_bath"),
        (c("n") % 5).alias("bedroom_abv_gr"),
        (c("n") % 9).alias("tot_rms_abv_grd"),
        (c("returned") % 3).alias("fireplaces"),
        (c("returned") % 4).alias("garage_cars"),
        (c("tax") * 100).alias("garage_area"),
        (c("disc") * 100).alias("wood_deck_sf"),
        c("mean_qty").alias("open_porch_sf"),
        F.when(c("returned") > 0, c("tax")).alias("enclosed_porch"),
        F.coalesce(grade, F.when(c("p_type") == "MEDIUM", "Gd").when(c("p_type") == "LARGE", "Ex")).alias("bsmt_qual"),
        c("p_brand").alias("neighborhood"),
        (c("unit") / 100).alias("sale_price"),
    )
