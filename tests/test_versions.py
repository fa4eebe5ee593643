"""Stored tables: transactions, replacing, numbering, layouts, readers of older versions."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import versions as V

HEAD = "ProjectCode string, RevisionCode string, InvoiceName string"
ITEMS = "Id string, BillNumber string, UnitRate double"


@pytest.fixture
def store(spark, tmp_path):
    s = V.Store(spark, f"file://{tmp_path}/store", buckets=4)
    s.migrate()
    return s


def items(spark, n, rate=1.0):
    return spark.range(n).select(F.col("id").cast("string").alias("Id"), F.lit("B").alias("BillNumber"), (F.col("id") * rate).alias("UnitRate"))


def head(spark, code="P", invoice=""):
    return spark.createDataFrame([(code, "R", invoice)], HEAD)


def test_snapshots_are_numbered(spark, store):
    assert [V.save_snapshot(store, head(spark), items(spark, 5)), V.save_snapshot(store, head(spark, "Q", "inv"), items(spark, 3))] == [1, 2]
    assert sorted((r.RevisionId, r.InvoiceName) for r in store.read("Snapshots").collect()) == [(1, "P"), (2, "inv")]
    assert sorted(r.Id for r in store.read("SnapshotItems").collect()) == [*(f"1_{i}" for i in range(5)), *(f"2_{i}" for i in range(3))]


def test_replace_and_older_versions(spark, store):
    V.save_snapshot(store, head(spark), items(spark, 8))
    before = store.version()
    rows = spark.createDataFrame([("1_2", 70.0, 1), ("1_2", 71.0, 2), ("9_9", 5.0, 1)], "Id string, UnitRate double, n int")
    store.run(lambda t: t.replace("SnapshotItems", rows, "n"))
    now = {r.Id: r.UnitRate for r in store.read("SnapshotItems").collect()}
    assert now["1_2"] == 71.0 and now["9_9"] == 5.0 and len(now) == 9
    then = {r.Id: r.UnitRate for r in store.read("SnapshotItems", before).collect()}
    assert then["1_2"] == 2.0 and len(then) == 8
    assert [r.UnitRate for r in store.read("SnapshotItems", keys=["1_2"]).collect()] == [71.0]
    assert len(store.read("SnapshotItems", keys=["1_2"]).inputFiles()) < len(store.read("SnapshotItems").inputFiles())


def test_one_of_two_writers_wins(spark, store):
    V.save_snapshot(store, head(spark), items(spark, 2))
    a, b = store.begin(), store.begin()
    a.replace("SnapshotItems", spark.createDataFrame([("1_0", "B", 10.0)], ITEMS))
    b.replace("SnapshotItems", spark.createDataFrame([("1_1", "B", 20.0)], ITEMS))
    a.commit()
    with pytest.raises(V.Conflict):
        b.commit()
    tries = []

    def change(t):
        t.replace("SnapshotItems", spark.createDataFrame([("1_1", "B", 20.0)], ITEMS))
        if not tries:  # another writer comes in between, once
            tries.append(1)
            other = store.begin()
            other.add("ItemAuditTrail", spark.createDataFrame([("1_0", "t")], "ItemId string, Timestamp string"), "Timestamp")
            other.commit()

    store.run(change)
    assert {r.Id: r.UnitRate for r in store.read("SnapshotItems").collect()} == {"1_0": 10.0, "1_1": 20.0}
    assert store.read("ItemAuditTrail").count() == 1


def test_a_write_without_commit_is_not_seen(spark, store):
    V.save_snapshot(store, head(spark), items(spark, 4))
    t = store.begin()
    t.replace("SnapshotItems", items(spark, 4, 9.0))
    t.delete("SnapshotItems", store.read("SnapshotItems").select("Id"))
    assert sorted(r.UnitRate for r in store.read("SnapshotItems").collect()) == [0.0, 1.0, 2.0, 3.0]
    store.sweep()
    assert sorted(r.UnitRate for r in store.read("SnapshotItems").collect()) == [0.0, 1.0, 2.0, 3.0]


def test_layouts(spark, tmp_path):
    s = V.Store(spark, f"file://{tmp_path}/old", buckets=2)
    s.migrate(1)
    s.run(lambda t: t.add("Snapshots", spark.createDataFrame([("P", "R")], "ProjectCode string, RevisionCode string"), "ProjectCode"))
    assert "InvoiceName" not in s.read("Snapshots").columns
    s.migrate()
    assert s.state()["user_version"] == 3 and s.read("Snapshots").first().InvoiceName is None
    assert "InvoiceName" not in s.read("Snapshots", 2).columns


def test_presets_and_audit(spark, store):
    preset = lambda names: spark.createDataFrame([(n, k) for k, n in enumerate(names)], "PresetName string, TargetRateCol int")
    store.run(lambda t: t.replace("MappingPresets", preset(["a", "b", "c"])))
    store.run(lambda t: t.delete("MappingPresets", preset(["b", "x"])))
    assert sorted(r.PresetName for r in store.read("MappingPresets").collect()) == ["a", "c"]
    log = lambda k: spark.createDataFrame([(str(k), f"2024-01-0{k}"), (str(k), f"2024-02-0{k}")], "ItemId string, Timestamp string")
    for k in (1, 2):
        store.run(lambda t: t.add("ItemAuditTrail", log(k), "Timestamp"))  # noqa: B023
    assert [(r.AuditId, r.ItemId) for r in store.read("ItemAuditTrail").orderBy("AuditId").collect()] == [(1, "1"), (2, "1"), (3, "2"), (4, "2")]


def test_empty(spark, store):
    assert store.read("Snapshots").count() == 0
    assert V.save_snapshot(store, head(spark), items(spark, 0)) == 1 and store.read("SnapshotItems").count() == 0
