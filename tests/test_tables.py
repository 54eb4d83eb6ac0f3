"""Keyed tables, refreshes and imports beside dictionaries, with broken and repeated runs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import refresh
from kinweave.sources import files, tables

SCHEMA = "id long, at long, text string"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def held(spark, table, version=None):
    return {r["id"]: (r["at"], r["text"]) for r in table.read(spark, version).collect()}


@pytest.mark.parametrize("order", [("at",), ()])
def test_merges_are_those_of_a_dictionary(spark, tmp_path, order):
    rnd = random.Random(len(order))
    table = tables.created(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "id", order, 8)
    expected, states = {}, {}
    for version in range(5):
        rows = [(rnd.randrange(40), rnd.randrange(10) * 100 + version * 10 + n, f"{version}.{n}") for n in range(rnd.choice([0, 3, 30]))]
        rows = list({r[0]: r for r in rows}.values()) if not order else rows
        gone = [rnd.randrange(40)] if version % 2 else []
        for i, at, text in rows:
            if not order or i not in expected or (at, 1) >= (expected[i][0], 0):
                expected[i] = (at, text)
        for g in gone:
            expected.pop(g, None)
        frame = spark.createDataFrame(rows + rows[:2], SCHEMA)
        tables.merge(spark, table, frame, version, spark.createDataFrame([(g,) for g in gone], "id long"))
        assert tables.merge(spark, table, frame, version) == {"buckets": 0, "rows": 0}
        states[version] = dict(expected)
        assert held(spark, table) == expected
    assert all(held(spark, table, v) == states[v] for v in states)
    with pytest.raises(ValueError):
        tables.merge(spark, table, spark.createDataFrame([], SCHEMA), -1)


def test_a_merge_writes_in_proportion_to_the_change(spark, tmp_path):
    path = str(tmp_path / "t")
    table = tables.created(spark, path, spark.createDataFrame([], SCHEMA).schema, "id", ("at",), 64)
    rows = spark.range(20_000).select("id", F.lit(0).cast("long").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    assert tables.merge(spark, table, rows, 0) == {"buckets": 64, "rows": 20_000}
    told = tables.merge(spark, table, rows.where("id < 2").withColumn("at", F.lit(1).cast("long")), 1)
    assert told["buckets"] <= 2 and size(f"{path}/data/version=1") < size(f"{path}/data/version=0") / 20
    # A late row of less order, and one without a key.
    tables.merge(spark, table, spark.createDataFrame([(1, -5, "late")], SCHEMA), 2)
    assert held(spark, table)[1][0] == 1
    with pytest.raises(Exception, match="no key"):
        tables.merge(spark, table, spark.createDataFrame([(None, 1, "x")], SCHEMA), 3)
    assert table.read(spark).count() == 20_000


def test_what_a_broken_merge_left_isn_t_read(spark, tmp_path):
    path = str(tmp_path / "t")
    table = tables.created(spark, path, spark.createDataFrame([], SCHEMA).schema, "id", ("at",), 4)
    tables.merge(spark, table, spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], SCHEMA), 0)
    spark.createDataFrame([(9, 9, "junk", 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    assert sorted(held(spark, tables.opened(spark, path))) == [1, 2]
    tables.merge(spark, table, spark.createDataFrame([(3, 1, "c")], SCHEMA), 1)
    assert sorted(held(spark, table)) == [1, 2, 3]


SOURCE = "id string, text string, venue string, chronology long, ordinal long, priority long"


def test_refreshes_are_certified_and_made_once(spark, tmp_path, monkeypatch):
    kept = "id string, text string, venue string, chronology long"
    store = tables.created(spark, str(tmp_path / "s"), spark.createDataFrame([], kept).schema, "id", (), 4)
    first = spark.createDataFrame([("a", "t1", "v", 3, 0, 1), ("a", "t1 new", "v", 3, 1, 2), ("b", "t2", "v", 2, 2, 1), ("c", "t3", "v", 1, 3, 1)], SOURCE)
    row = refresh.refresh(spark, store, first, 1, n=2).first()
    assert (row["appended"], row["members"], row["examined"]) == (2, 2, 4) and {r["id"]: r["text"] for r in refresh.active(spark, store).collect()} == {"a": "t1 new", "b": "t2"}
    # A larger selection adds what is missing only.
    row = refresh.refresh(spark, store, first, 2, n=3).first()
    assert (row["appended"], row["replaced"], row["refreshed"], row["unchanged"], row["members"]) == (1, 0, 0, 2, 3)
    second = spark.createDataFrame([("a", "t1 new", "other", 3, 0, 1), ("c", "changed", "v", 1, 1, 1)], SOURCE)
    real = tables.merge

    def breaks(*args):
        real(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "merge", breaks)
    with pytest.raises(RuntimeError):
        refresh.refresh(spark, store, second, 3)
    # What is active is what was certified last.
    assert {r["id"]: r["text"] for r in refresh.active(spark, store).collect()} == {"a": "t1 new", "b": "t2", "c": "t3"}
    monkeypatch.setattr(tables, "merge", real)
    row = refresh.refresh(spark, store, second, 3).first()
    assert (row["appended"], row["replaced"], row["refreshed"], row["unchanged"], row["absent"], row["members"]) == (0, 1, 1, 0, 1, 2)
    assert refresh.refresh(spark, store, first, 3).first() == row
    assert sorted((r["id"], r["text"], r["venue"]) for r in refresh.active(spark, store).collect()) == [("a", "t1 new", "other"), ("c", "changed", "v")] and store.read(spark).count() == 3
    refresh.refresh(spark, store, second, 4, retire=True)
    assert store.read(spark).count() == 2


def test_an_import_goes_on_where_it_broke(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.col("id").alias("row_number"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    source, target = str(tmp_path / "snap"), str(tmp_path / "store")
    files.write_snapshot(rows, source, shards=3, model="m")
    real, calls = files.log_shards, []

    def breaks(spark, entries, destination):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(entries)
        real(spark, entries, destination)

    monkeypatch.setattr(files, "log_shards", breaks)
    with pytest.raises(RuntimeError):
        files.import_snapshot(spark, source, target, batch_rows=90, at_once=2, model="m")
    before = {f: os.path.getmtime(os.path.join(d, f)) for s in range(4) for d, _, names in os.walk(f"{target}/rows/shard={s}") for f in names}
    assert before and not os.path.exists(f"{target}/manifest")
    monkeypatch.setattr(files, "log_shards", real)
    assert files.import_snapshot(spark, source, target, batch_rows=90, at_once=2, model="m") == 8
    assert before == {f: os.path.getmtime(os.path.join(d, f)) for s in range(4) for d, _, names in os.walk(f"{target}/rows/shard={s}") for f in names}
    assert files.read_snapshot(spark, target, model="m").drop("shard").exceptAll(rows).count() == 0
    assert files.import_snapshot(spark, source, target, batch_rows=90, model="m") == 0
    with pytest.raises(ValueError):
        files.import_snapshot(spark, source, target, batch_rows=90, model="other")
    files.write_snapshot(rows.withColumn("text", F.lit("x")), str(tmp_path / "new"), model="m")
    with pytest.raises(ValueError, match="other rows"):
        files.import_snapshot(spark, str(tmp_path / "new"), target, batch_rows=90, model="m")
