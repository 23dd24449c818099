"""Category dictionaries against plain sorting, and sparse vectors."""

import pytest

from tallygrove.operators import dictionary as dc


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"v{i * 7919 % 25_000}", None if i % 10 == 0 else "xyz"[i % 3], float(i)) for i in range(25_000)]
    return spark.createDataFrame(data, "id long, wide string, `small.one` string, x double").repartition(7).persist()


def test_slots_are_ranks(rows):
    found = dc.CategoryDictionary.fit(rows, ["wide", "small.one"])
    assert list(found.sizes) == [25_000, 4]
    for i, c in enumerate(found.cols):
        table = found.table.where(f"column = {i}").toPandas().sort_values("slot")
        assert table.slot.tolist() == list(range(len(table))) and table.value.tolist() == sorted(table.value)
    counts = {r.value: r.n for r in found.table.where("column = 1").collect()}
    assert counts["nan"] == 2500 and sum(counts.values()) == 25_000


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_unknown_values_and_join_ways(rows, monkeypatch, broadcast):
    monkeypatch.setattr(dc, "BROADCAST_VALUES", broadcast)
    found = dc.CategoryDictionary.fit(rows.where("id < 20000"), ["wide", "small.one"])
    assert found.small == bool(broadcast)
    got = found.index(rows).select("id", "wide", "wide_slot", "`small.one_slot`").toPandas()
    assert len(got) == 25_000
    known = sorted({f"v{i * 7919 % 25_000}" for i in range(20_000)})
    slot = {v: i for i, v in enumerate(known)}
    assert all((slot.get(w, -1)) == (-1 if s != s else int(s)) for w, s in zip(got.wide, got.wide_slot))


def test_sparse_vectors(spark):
    train = spark.createDataFrame([(1, "b", "p", 0.5), (2, "a", None, 1.5), (3, "b", "p", 2.5)], "id int, u string, w string, x double")
    found = dc.CategoryDictionary.fit(train, ["u", "w"])
    new = spark.createDataFrame([(1, "a", "p", 3.0), (2, "zzz", None, 4.0), (3, None, "q", 5.0)], "id int, u string, w string, x double")
    got = {r.id: r.features for r in found.encode(new, ["x"]).collect()}
    assert got[1].toArray().tolist() == [3, 1, 0, 0, 1] and got[2].toArray().tolist() == [4, 0, 0, 1, 0]
    assert got[3].toArray().tolist() == [5, 0, 0, 0, 0]
    assert found.encode(new, ["x"]).columns == [*new.columns, "features"]


def test_wide_vectors_stay_sparse_and_plans_small(rows):
    found = dc.CategoryDictionary.fit(rows, ["wide"])
    encoded = found.encode(rows.withColumnRenamed("small.one", "s"), ["x"])
    vector = encoded.first().features
    assert vector.size == 25_001 and len(vector.indices) <= 2
    assert "v777" not in encoded._jdf.queryExecution().toString()


def test_rare_and_constant_values_from_counts(spark):
    train = spark.createDataFrame([(i, "common" if i else "rare") for i in range(4000)], "id int, u string")
    found = dc.CategoryDictionary.fit(train, ["u"])
    assert sorted(r.value for r in dc.near_constant_values(found, 4000).collect()) == ["common", "rare"]
    assert dc.near_constant_values(found, 4000, 0.9999).count() == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], "id int, u string")
    found = dc.CategoryDictionary.fit(none, ["u"])
    assert list(found.sizes) == [0] and found.index(none).columns == ["id", "u", "u_slot"]
