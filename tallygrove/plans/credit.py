"""Credit-risk flow: engineer, split, preprocess on train, train, score, evaluate."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import scalars as fx
from tallygrove.operators import classification as cl
from tallygrove.operators import cleaning, evaluation, network, splits
from tallygrove.operators.preprocessing import Preprocess, PreprocessModel, assemble
from tallygrove.operators.statistics import require_complete

# fixed values: the columns of a loan table and what is done with them
KEPT_AMOUNT = "funded_amnt_inv"
NUMBERS = ["installment", "annual_inc", "dti", "revol_bal", "tot_coll_amt", "tot_cur_bal", "total_rev_hi_lim"]
PERCENTS = ["int_rate", "revol_util"]
COUNTS = [
    "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "total_acc", "collections_12_mths_ex_med", "acc_now_delinq",
]
CATEGORIES = [
    "purpose", "initial_list_status", "grade", "sub_grade", "home_ownership", "verification_status", "addr_state",
    "application_type",
]
# month counter -> (ever flag, recency flag, months, recency score)
COUNTERS = {
    "mths_since_last_delinq": ("ever_delinq", "delinq_24m", 24, "delinq_recency_score"),
    "mths_since_last_major_derog": ("ever_major_derog", "derog_60m", 60, "derog_recency_score"),
    "mths_since_last_record": ("ever_public_record", "record_60m", 60, "record_recency_score"),
}
NEVER = 999
ZERO_FILLED = ["tot_coll_amt", "tot_cur_bal", "total_rev_hi_lim"]
DEFAULTED = [
    "Charged Off",
    "Default",
    "Late (31-120 days)",
    "Does not meet the credit policy. Status:Charged Off",
]
FLAGS = [name for ever, recent, _, _ in COUNTERS.values() for name in (ever, recent)]
FEATURES = [
    KEPT_AMOUNT, *NUMBERS, *PERCENTS, *COUNTS, *FLAGS, *[score for *_, score in COUNTERS.values()], "credit_age",
]


def engineer(loans: DataFrame, date_format: str = "MMM-yyyy") -> DataFrame:
    """Raw loans -> id, label, numeric features and text categories. One projection and one filter.

    Rows without a count, ``revol_util`` (or with no number in it) or a date are dropped.

    Redundant amounts, raw month counters, raw dates and free text are left out.
    """
    derived: dict[str, Column] = {"int_rate": fx.parse_percent("int_rate")}
    for months, (ever, recent, limit, score) in COUNTERS.items():
        filled = F.coalesce(F.col(months), F.lit(NEVER))
        derived[ever] = fx.missing_flag(months)
        derived[recent] = fx.recency_flag(filled, derived[ever], limit)
        derived[score] = fx.recency_score(filled, derived[ever])
    complete = cleaning.drop_missing(loans.withColumn("revol_util", fx.parse_percent("revol_util")), [*COUNTS, "revol_util"])
    dated = complete.withColumns(
        {
            "issue_d": fx.parse_month_year("issue_d", date_format),
            "earliest_cr_line": fx.parse_month_year("earliest_cr_line", date_format),
        }
    )
    whole = cleaning.drop_missing(dated, ["issue_d", "earliest_cr_line"]).withColumns(
        {
            **derived,
            "credit_age": fx.year_gap("issue_d", "earliest_cr_line").cast("double"),
            "label": fx.label_from_classes("loan_status", DEFAULTED),
        }
    )
    filled = cleaning.fill_missing(whole, {c: 0 for c in ZERO_FILLED})
    return filled.select("id", "label", *FEATURES, *CATEGORIES)


@dataclass(frozen=True)
class CreditRun:
    model: PreprocessModel
    path: cl.LogisticPath
    threshold: float
    scored: DataFrame  # id, label, split, p; persisted
    tables: Mapping[str, DataFrame]


def prepare(loans: DataFrame, seed: int = 42, date_format: str = "MMM-yyyy") -> tuple[DataFrame, PreprocessModel]:
    """Stratified split and train-only preprocessing: persisted rows (id, label, split, features)."""
    # the cuts of the split need several passes: the loans are joined and engineered once for all of them
    whole = engineer(loans, date_format).persist(StorageLevel.MEMORY_AND_DISK)
    split = splits.split_stratified(whole, seed).persist(StorageLevel.MEMORY_AND_DISK)
    split.count()  # fill the cache, so the one before can go
    whole.unpersist()
    model = Preprocess(FEATURES, CATEGORIES, FLAGS).fit(split.where("split = 'train'"))
    wide = model.transform(split)
    require_complete(wide)
    rows = assemble(wide, model.features, ["id", "label", "split"]).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()  # fill the cache, so the split's can go
    split.unpersist()
    return rows, model


def run(loans: DataFrame, seed: int = 42, threshold_mode: str = "ks", grid=cl.C_GRID) -> CreditRun:
    """Logistic path chosen on validation rows; threshold chosen there too; every report table."""
    rows, model = prepare(loans, seed)
    path = cl.logistic_path(rows.where("split = 'train'"), rows.where("split = 'validation'"), grid)
    scored = cl.predict_proba(path.best, rows).select("id", "label", "split", "p").persist(StorageLevel.MEMORY_AND_DISK)
    scored.count()  # fill the cache, so the features can go
    rows.unpersist()
    t = evaluation.choose_threshold(scored.where("split = 'validation'"), threshold_mode)
    return CreditRun(model, path, t, scored, evaluation.evaluation_pack(scored, t))


def run_network(loans: DataFrame, seed: int = 42, n_trials: int = 8, base: network.MlpParams = network.MlpParams()) -> DataFrame:
    """Network search against the penalised-intercept baseline: one metric line per model and split."""
    rows, _ = prepare(loans, seed)
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    net, _ = network.mlp_random_search(train, validation, n_trials, seed, base)
    baseline = cl.logistic_penalised(train)
    lines = None
    for name, model in (("network", net), ("baseline", baseline)):
        scored = model.transform(rows).select("label", "split", "p").persist(StorageLevel.MEMORY_AND_DISK)
        t = evaluation.choose_threshold(scored.where("split = 'validation'"), "f1")
        table = evaluation.binary_metrics(scored, t).withColumn("model", F.lit(name))
        lines = table if lines is None else lines.unionByName(table)
    return lines
