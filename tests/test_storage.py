"""What is stored, beside the file system."""

import os

import pytest
from pyspark.sql import functions as F

from kinweave.sources import files, storage


def test_sizes_are_those_of_the_file_system(spark, tmp_path):
    root = tmp_path / "stores+1"
    for n, rows in (("a", 1000), ("b (2)", 10)):
        spark.range(rows).write.parquet(f"file://{root}/{n}")
    (root / "note.txt").write_text("12345")
    told = {r["namespace"]: (r["files"], r["bytes"]) for r in storage.sizes(spark, str(root), "namespace").collect()}
    expected = {}
    for d, _, names in os.walk(root):
        for f in names:
            if not f.startswith((".", "_")):
                n = os.path.relpath(os.path.join(d, f), root).split(os.sep)
                got = expected.get(n[0] if len(n) > 1 else "", (0, 0))
                expected[n[0] if len(n) > 1 else ""] = (got[0] + 1, got[1] + os.path.getsize(os.path.join(d, f)))
    assert told == expected and set(told) == {"a", "b (2)", ""}
    whole = storage.sizes(spark, f"file://{root}").first()
    assert (whole["files"], whole["bytes"]) == (sum(f for f, _ in expected.values()), sum(b for _, b in expected.values()))
    assert storage.purge(spark, str(root / "a")) and not (root / "a").exists() and not storage.purge(spark, str(root / "a"))
    with pytest.raises(ValueError):
        storage.purge(spark, "/tmp")


def test_rows_are_gathered_in_the_order_asked(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.col("id").alias("row_number"))
    source, store = str(tmp_path / "s"), str(tmp_path / "t")
    files.write_snapshot(rows, source)
    files.import_snapshot(spark, source, store, batch_rows=500)
    wanted = [4999, 7, 7, 2600, 0]
    got = storage.gathered(spark, store, spark.createDataFrame([*enumerate(wanted)], "pos long, row_number long"), 500)
    assert [r["id"] for r in got.collect()] == [f"k{w}" for w in wanted]
    assert len({f.split("shard=")[1].split("/")[0] for f in spark.read.parquet(f"{store}/rows").where("shard in (0, 5, 9)").inputFiles()}) <= 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "PushedFilters: [IsNotNull(row_number), GreaterThanOrEqual(row_number,0), LessThanOrEqual(row_number,4999)" in plan
    assert storage.gathered(spark, store, spark.createDataFrame([], "pos long, row_number long"), 500).collect() == []
    with pytest.raises(Exception, match="no row is stored at 5000"):
        storage.gathered(spark, store, spark.createDataFrame([(0, 1), (1, 5000)], "pos long, row_number long"), 500).collect()


def test_batches_and_physical_order(spark):
    rows = spark.range(10).select("id", (100 - F.col("id")).alias("row_idx"))
    assert [[r["id"] for r in b] for b in storage.batches(rows, 4, "row_idx")] == [[9, 8, 7, 6], [5, 4, 3, 2], [1, 0]]
    assert list(storage.batches(rows.limit(0), 4)) == []
    with pytest.raises(ValueError):
        list(storage.batches(rows, 0))
    assert [(r["id"], r["pos"]) for r in storage.in_physical_order(rows, spark.createDataFrame([(3,), (5,), (5,), (77,)], "id long")).collect()] == [(5, 1), (3, 2)]
