"""The kept table of latest rows against one window over all batches."""

import os
import random

import pytest

from mailsleuth.operators.components import PARENT_ROW, components, grow_components, kept_components
from mailsleuth.sources.keyed_table import KeyedTable
from mailsleuth.session import children

ROW = "k string, tenant string, at int, v string"


def table_of(spark, path, **options):
    return KeyedTable(spark, str(path), ROW, ["k", "tenant"], ["at"], **{"buckets": 4, "max_deltas": 2, "bucket_by": ["k"], **options})


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_batches_equal_the_latest_rows(spark, tmp_path):
    rng, table, want = random.Random(2), table_of(spark, tmp_path / "t"), {}
    assert table.read().collect() == [] and table.manifest()[1] == -1
    for batch in range(9):
        rows = [(rng.choice([None, *(f"k{i}" for i in range(30))]), rng.choice(["t", None]), rng.randrange(20), f"{batch}-{i}") for i in range(rng.choice([0, 5, 40]) if batch != 4 else 0)]
        rows = list({(k, t, at): (k, t, at, v) for k, t, at, v in rows}.values())  # no ties within a batch
        assert table.upsert(spark.createDataFrame(rows, ROW), batch)
        for k, t, at, v in rows:
            if (k, t) not in want or at >= want[k, t][0]:
                want[k, t] = (at, v)
        assert {(r["k"], r["tenant"]): (r["at"], r["v"]) for r in table.read().collect()} == want
    entries = table.manifest()[2]
    assert any(r["is_base"] for r in entries) and len(entries) <= 4 * 3
    asked = spark.createDataFrame([("k1",), ("k2",), ("none",)], "k string")
    assert {(r["k"], r["tenant"]) for r in table.read(asked).collect()} == {key for key in want if key[0] in ("k1", "k2")}


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    table, path = table_of(spark, tmp_path / "t"), tmp_path / "t"
    table.upsert(spark.createDataFrame([(f"k{i}", "t", 0, "a") for i in range(200)], ROW), 0)
    first = files(path / "rows")
    touched = {r["b"] for r in spark.createDataFrame([("k5",)], "k string").select(table.bucket().alias("b")).collect()}
    for batch in range(1, 8):
        before = {(r["bucket"], r["folder"]) for r in table.manifest()[2]}
        table.upsert(spark.createDataFrame([("k5", "t", batch, str(batch))], ROW), batch)
        after = {(r["bucket"], r["folder"]) for r in table.manifest()[2]}
        assert {b for b, _ in before ^ after} == touched
        assert sum(b in touched for b, _ in after) <= 3
    now = files(path / "rows")
    assert all(now[f] == at for f, at in first.items())
    assert all(f"bucket={next(iter(touched))}" in f for f in set(now) - set(first))
    assert len(files(path / "manifest")) == 8 and table.read().where("k = 'k5'").first()["v"] == "7"


def test_replayed_and_broken_batches(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path / "t")
    table.upsert(spark.createDataFrame([("a", "t", 1, "x")], ROW), 3)
    assert not table.upsert(spark.createDataFrame([("a", "t", 9, "y")], ROW), 3) and not table.upsert(spark.createDataFrame([("a", "t", 9, "y")], ROW), 2)
    write = KeyedTable._write
    monkeypatch.setattr(KeyedTable, "_write", lambda self, rows, folder: (write(self, rows, folder), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        table.upsert(spark.createDataFrame([("a", "t", 9, "y"), ("b", "t", 9, "y")], ROW), 4)
    monkeypatch.setattr(KeyedTable, "_write", write)
    assert [tuple(r) for r in table.read().collect()] == [("a", "t", 1, "x")]
    os.makedirs(tmp_path / "t/manifest/version=2")  # a manifest that broke off before its file was there
    assert [tuple(r) for r in table.read().collect()] == [("a", "t", 1, "x")]
    assert table.upsert(spark.createDataFrame([("a", "t", 0, "old"), ("b", "t", 9, "y")], ROW), 4)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "t", 1, "x"), ("b", "t", 9, "y")]
    assert children(spark, str(tmp_path / "none")) == []


def test_components_grow_by_batches(spark, tmp_path):
    rng, edges = random.Random(3), []
    table = KeyedTable(spark, str(tmp_path / "forest"), PARENT_ROW, ["v"], ["step"], buckets=4, max_deltas=2)
    for batch in range(5):
        new = [(rng.randrange(80), rng.randrange(80)) for _ in range(14)] if batch != 2 else []
        edges += new
        assert grow_components(table, spark.createDataFrame(new, "a long, b long"), batch)
        want = {(r["v"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {(r["v"], r["root"]) for r in kept_components(table).collect()} == want
    assert not grow_components(table, spark.createDataFrame([(1, 900)], "a long, b long"), 4)


def test_a_batch_writes_its_own_components_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "forest"), PARENT_ROW, ["v"], ["step"], buckets=4, max_deltas=9)
    grow_components(table, spark.createDataFrame([(10 * c, 10 * c + i) for c in range(1, 30) for i in range(1, 5)], "a long, b long"), 0)
    grow_components(table, spark.createDataFrame([(13, 24), (500, 14)], "a long, b long"), 1)
    written = table.read().where("step = 1").collect()
    assert {(r["v"], r["root"]) for r in written} == {(20, 10), (500, 10)}
    assert {r["v"] for r in kept_components(table).where("root = 10").collect()} == {11, 12, 13, 14, 20, 21, 22, 23, 24, 500}
