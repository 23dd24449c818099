import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import neighbours as nb


def brute(q, t, k, same):
    out = {}
    for i, a in enumerate(q):
        d = np.sqrt(((t - a) ** 2).sum(1))
        order = sorted((x, j) for j, x in enumerate(d) if not (same and i == j))
        out[i] = [(j, x) for x, j in order[:k]]
    return out


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>").repartition(4)


def check(got, want):
    rows = {}
    for r in got.orderBy("id", "rank").collect():
        rows.setdefault(r.id, []).append((r.neighbour, r.distance))
    assert rows.keys() == want.keys()
    for i, w in want.items():
        assert [j for j, _ in rows[i]] == [j for j, _ in w]
        assert [d for _, d in rows[i]] == pytest.approx([d for _, d in w])


@pytest.mark.parametrize("pivots,block", [(1, 1000), (7, 16), (40, 8)])
def test_equals_brute_force(spark, pivots, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x[:100] = x[0]  # a third of the rows are copies of one
    check(nb.knn(table(spark, x), table(spark, x), 4, skip_self=True, pivots=pivots, block=block), brute(x, x, 4, True))


def test_two_tables_and_few_rows(spark):
    rng = np.random.default_rng(9)
    t, q = rng.normal(size=(60, 2)), rng.normal(size=(25, 2)) * 5
    check(nb.knn(table(spark, t), table(spark, q), 3, pivots=9, block=7), brute(q, t, 3, False))
    check(nb.knn(table(spark, t[:2]), table(spark, q), 3, pivots=2), brute(q, t[:2], 3, False))


def test_vote_ties(spark):
    found = spark.createDataFrame(
        [(1, 10, 0.5), (1, 11, 0.2), (1, 12, 0.9), (1, 13, 0.9), (2, 10, 0.1), (2, 11, 0.1)],
        "id bigint, neighbour bigint, distance double",
    )
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 0), (13, 1)], "id bigint, label int")
    got = {r.id: (r.predicted, r.votes) for r in nb.knn_vote(found, labels).collect()}
    assert got == {1: (1, 2), 2: (0, 1)}  # the nearer, then the lower id


def test_no_cross_join(spark):
    x = table(spark, np.eye(4))
    plan = nb.knn(x, x, 2, pivots=2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_single_precision_and_few_groups(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(150, 3)).astype(np.float32).astype(np.float64)
    rows = table(spark, x).select("id", F.col("vec").cast("array<float>").alias("vec"))
    got = nb.knn(rows, rows, 4, skip_self=True, pivots=5, block=20)
    check(got, brute(x, x, 4, True))
    assert "array<double>" not in got._jdf.queryExecution().optimizedPlan().toString()  # single as given, so short to shuffle
    many = spark.range(3000).selectExpr("id", "array(float(id), float(id % 7)) AS vec")
    assert len(nb._pivots(many, None)[0]) == 1  # a query goes to few groups
