import pytest
from pyspark.sql import functions as F

from tallygrove.operators import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))


def sides(df):
    return {r.id: r.split for r in df.collect()}


def test_exact_sizes(rows):
    got = list(sides(splits.split_random(rows, 0.1, 3)).values())
    assert got.count("test") == 101 and len(got) == 1003
    got = list(sides(splits.split_exact(rows, 700, 200, 3)).values())
    assert [got.count(s) for s in ("train", "test", "validation")] == [700, 200, 103]
    with pytest.raises(ValueError):
        splits.split_exact(rows, 1000, 200, 3)


def test_stratified(rows):
    df = splits.split_stratified(rows, 3)
    table = {(r.label, r.split): r["count"] for r in df.groupBy("label", "split").count().collect()}
    assert sum(v for (_, s), v in table.items() if s == "test") == 201
    assert table[1, "test"] == round(144 * 201 / 1003)
    assert sum(table.values()) == 1003


def test_unchanged_by_partitioning(rows):
    assert sides(splits.split_stratified(rows, 3)) == sides(splits.split_stratified(rows.repartition(13), 3))
    assert sides(splits.split_random(rows, 0.3, 1)) != sides(splits.split_random(rows, 0.3, 2))


def test_shared_hashes_are_divided_by_id(rows, monkeypatch):
    monkeypatch.setattr(splits, "hash_order", lambda c, seed: (F.col(c) % 3).cast("bigint"))
    got = sides(splits.split_random(rows, 0.5, 1))
    test = sorted((i % 3, i) for i, s in got.items() if s == "test")
    assert test == sorted((i % 3, i) for i in range(1003))[:502]


def test_shuffle_keeps_rows(rows):
    got = [r.id for r in splits.shuffle_rows(rows, 5).collect()]
    assert sorted(got) == list(range(1003)) and got != list(range(1003))


def test_quotas():
    assert splits.quotas({0: 10, 1: 10, 2: 10}, 10) == {0: 4, 1: 3, 2: 3}
