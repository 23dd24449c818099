from pyspark.sql import functions as F

from tallygrove.catalogue import models
from tallygrove.plans import fixtures as fx


def test_join_of_large_tables_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 2001).select(
        F.when(F.col("id") % 50 == 0, 50).otherwise(F.col("id")).alias("o_orderkey"),  # an id with 40 rows
        (F.col("id") % 30).alias("o_custkey"),
        F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus"),
        (F.col("id") * 137.0 % 5000).alias("o_totalprice"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(30).select(F.col("id").alias("c_custkey"), (F.col("id") * 10.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")

    def found():
        rows = models._features(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        return plan, sorted(map(tuple, rows.select("id", "label", "split", F.col("features").cast("string")).collect()))

    plan, want = found()
    assert "REPARTITION_BY_NUM" not in plan  # small tables are left to the planner
    monkeypatch.setattr(fx, "TASK_ROWS", 100, raising=False)
    plan, got = found()
    assert plan.count("REPARTITION_BY_NUM") == 2 and f", {2000 // 100}), REPARTITION_BY_NUM" in plan
    assert got == want and len(got) == 1960 + 40 * 40
