import re

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import evaluation as ev
from tallygrove.operators import ranking as rk


@pytest.mark.parametrize("slots", [1, 7, 64])
def test_running_rows_is_the_global_order(scored, slots):
    got = rk.running_rows(scored, "p", "id", ["label"], slots=slots).toPandas().sort_values("row_no")
    want = scored.toPandas().sort_values(["p", "id"])
    assert got["row_no"].tolist() == list(range(1, 2001))
    assert got["id"].tolist() == want["id"].tolist()
    assert got["run_label"].tolist() == want["label"].cumsum().tolist()
    assert set(got["n_rows"]) == {2000} and set(got["total_label"]) == {want["label"].sum()}


def test_hot_score_is_divided(scored):
    sizes = rk.with_slots(scored, "p", "id", 24).groupBy(rk.SLOT).count().toPandas()["count"]
    assert sizes.max() < 2000 / 24 * 3  # the shared score alone holds 667 rows


def test_constant_score(spark):
    df = spark.range(1000).select("id", F.lit(0.5).alias("p"), (F.col("id") % 2).cast("int").alias("label"))
    got = rk.running_rows(df, "p", "id", ["label"], slots=16).orderBy("row_no").collect()
    assert [r.id for r in got] == list(range(1000))
    assert got[-1].run_label == 500


def test_running_rows_by_group(scored):
    df = scored.withColumn("g", F.col("id") % 3)
    got = rk.running_rows(df, "p", "id", ["label"], ["g"]).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values(["p", "id"])
        assert part["row_no"].tolist() == list(range(1, len(part) + 1))
        assert part["run_label"].tolist() == part["label"].cumsum().tolist()


def test_null_score_raises(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 0.5, 1)], "id bigint, p double, label int")
    with pytest.raises(ValueError, match="no value"):
        rk.running_rows(df, "p", "id")


def test_gains_bins_of_fifteen(spark):
    df = spark.range(15).select("id", (F.col("id") / 20).alias("p"), (F.col("id") % 2).cast("int").alias("label"))
    got = rk.gains_table(df).orderBy("decile").collect()
    assert [r.n for r in got] == [2, 1, 2, 1, 2, 1, 1, 2, 1, 2]
    assert got[-1].capture == pytest.approx(1.0) and sum(r.n for r in got) == 15


def test_few_rows_keep_empty_bins(spark):
    df = spark.range(4).select("id", (F.col("id") / 20).alias("p"), F.lit(1).alias("label"))
    got = rk.safest_first_table(df).orderBy("decile").collect()
    assert [r.n for r in got] == [1, 0, 1, 0, 0, 1, 0, 1, 0, 0]
    assert got[1].avg_p is None
    assert sum(r.n for r in rk.gains_table(df).collect()) == 4


def test_topk_rounds_half_to_even(spark):
    df = spark.range(250).select("id", (F.col("id") / 300).alias("p"), F.lit(1).alias("label"))
    assert {r.fraction: r.m for r in rk.topk_capture(df, [0.01, 0.05]).collect()} == {0.01: 2, 0.05: 12}


@pytest.mark.parametrize(
    "make",
    [
        rk.gains_table, rk.safest_first_table, rk.topk_capture, ev.roc_points, ev.auc, ev.ks_cdf, ev.accuracy_ratio,
        ev.cap_curve, ev.average_precision,
    ],
)
def test_rows_never_meet_in_one_task(scored, make):
    """A single-partition exchange may only follow an aggregation."""
    plan = make(scored)._jdf.queryExecution().executedPlan().toString()
    nodes = [re.sub(r"^[\s:|+\-*()\d]*", "", line) for line in plan.splitlines()]
    for i, node in enumerate(nodes):
        if node.startswith("Exchange SinglePartition"):
            below = next(n for n in nodes[i + 1 :] if not n.startswith("Project"))
            assert below.startswith(("HashAggregate", "SortAggregate")), below


@pytest.mark.parametrize("name", [lambda i: f"customer-{i:06d}", lambda i: f"é{i * 7919 % 1999}", lambda i: f"{'x' * (i % 5)}{i}"])
def test_text_ids_with_one_score_on_half_the_rows(spark, name):
    rows = [(name(i), 0.5 if i % 2 else (i * 37 % 1000) / 1000, i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, p double, label int").repartition(6)
    got = rk.running_rows(df, "p", "id", ["label"], slots=16).collect()
    want = sorted(rows, key=lambda r: (r[1], r[0].encode()))
    at = {r[0]: (k + 1, sum(x[2] for x in want[: k + 1])) for k, r in enumerate(want)}
    assert {r.id: (r.row_no, r.run_label) for r in got} == at
    slots = rk.with_slots(df, "p", "id", 16).groupBy("_slot").count().toPandas()
    assert slots["count"].max() < 700  # the tie of 1,000 rows is divided
    plan = rk.running_rows(df, "p", "id", ["label"], slots=16)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]
