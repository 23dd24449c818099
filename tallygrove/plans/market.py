"""Market flows: principal components of returns, clusters of equities, and general regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.scalars import floor_log, signed_log, to_number
from tallygrove.operators import clustering, cleaning, factors, panel, regression
from tallygrove.operators.preprocessing import assemble
from tallygrove.session import shared_folder
from tallygrove.sources.tables import null_if_token, split_xy


@dataclass(frozen=True)
class ReturnFactors:
    returns: DataFrame  # long: date, ticker, ret
    covariance: DataFrame
    components: factors.Factors
    projection: DataFrame


def return_factors(prices: DataFrame, last: int = 400, k: int = 3) -> ReturnFactors:
    """Prices (date, ticker, price) -> aligned returns, covariance, components and factor scores; nothing is pivoted."""
    spark = prices.sparkSession
    shared_folder(spark)
    kept = panel.tail_dates(prices, "date", last)
    returns = panel.date_align(panel.pct_change(kept, "ticker", "date", "price"), "ticker", "date", "ret").checkpoint()  # read several times below
    fitted = factors.panel_factors(returns, "ticker", "date", "ret", k)
    return ReturnFactors(returns, factors.covariance_blocks(fitted.panel), fitted, fitted.scores(spark, "date"))


def clean_equities(raw: DataFrame) -> DataFrame:
    """``--`` is missing, missing and negative are 0, then the log: (id, peg, cap)."""
    named = null_if_token(raw, ["--"])
    zeroed = named.select("id", *[F.coalesce(to_number(c), F.lit(0.0)).alias(c) for c in ("peg", "cap")])
    return zeroed.select("id", floor_log("peg").alias("peg"), floor_log("cap").alias("cap"))


def log_equities(clean: DataFrame) -> DataFrame:
    """Missing is 0, then the signed log."""
    zeroed = cleaning.fill_all_zero(clean)
    return zeroed.select("id", signed_log("peg").alias("peg"), signed_log("cap").alias("cap"))


def cluster_equities(equities: DataFrame, k: int = 9, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """Rows with their cluster, numbered by ascending centre, and the centres."""
    rows = assemble(equities, ["peg", "cap"], ["id", "peg", "cap"]).persist()
    try:
        _, centres = clustering.kmeans(rows, k, seed)
    finally:
        rows.unpersist()
    return clustering.kmeans_assign(equities.withColumn("vec", F.array("peg", "cap")), centres, "vec").drop("vec"), centres


def run_regression(
    table: DataFrame, target: str = "target", rate: float = 1e-3, steps: int = 100_000, tol: float = 1e-7
) -> DataFrame:
    """Least squares by descent on every column of a numeric table: (feature, coefficient)."""
    xy, features = split_xy(table, target)
    return regression.linreg_gd(xy, features, "target", rate, steps, tol).table(table.sparkSession)
