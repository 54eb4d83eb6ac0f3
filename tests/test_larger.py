"""Queries against their SQL on tables that are larger than those of the driver, or have more copies and greater keys."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import geometry, ranking, reconcile, textsim
from kinweave.plans import catalog
from kinweave.sources import files
from tests.oracle import agree

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder with the smallest tables, some of them replaced by what SQL makes."""

    def made(**replaced: str) -> str:
        for name in os.listdir(SF):
            os.symlink(f"{SF}/{name}", tmp_path / name)
        for name, sql in replaced.items():
            (tmp_path / f"{name}.parquet").unlink()
            duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return made


@pytest.mark.parametrize("name", ["bibliography_entries", "matched_entries", "bibliography_references"])
def test_keys_of_six_digits_have_numbers_of_their_own(spark, tables, name):
    # The first five digits of 120,000 are those of 12,000.
    moved = "CASE i WHEN 0 THEN {0} WHEN 1 THEN {0} + 12000 ELSE {0} * 10 + 120000 END"
    sf = tables(
        part=f"SELECT * REPLACE ({moved.format('p_partkey')} AS p_partkey) FROM '{SF}/part.parquet', range(3) g(i)",
        lineitem=f"SELECT * REPLACE (l_orderkey + i * 100000 AS l_orderkey, {moved.format('l_partkey')} AS l_partkey) FROM '{SF}/lineitem.parquet', range(3) g(i) WHERE l_orderkey % 4 < 2",
    )
    agree(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", ["index_search", "index_recall"])
def test_an_index_of_more_rows_than_a_sample_has_the_ranges_of_all(spark, tables, name):
    vector = "list_transform(range(64), lambda k: CAST(hash(i % 2500 * 64 + k) % 2001 / 1000.0 - 1 AS FLOAT))"
    sf = tables(embeddings=f"SELECT i AS vec_id, {vector} AS embedding, CAST(i % 10 AS INT) AS label FROM range(2600) g(i)")
    agree(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf)


def test_copies_of_a_text_are_told_apart_by_their_ids(spark):
    words = [f"word{k * k % 61}" for k in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words if i % 2 == 0 else words[: i % 97])) for i in range(400)], "id long, text string").repartition(7)
    found = textsim.similar_to(textsim.weights(docs, 5000, ["the"]), 0, 20).collect()
    assert [r["id"] for r in found] == list(range(2, 42, 2))


def test_nearest_references_need_one_python_step_however_many_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[6]
    rows = spark.createDataFrame([(i, x[i].tolist(), i % 3 == 0) for i in range(300)] + [(300, None, True), (301, [float("nan")] * 8, True)], "id long, unit array<double>, is_reference boolean")
    found = ranking.with_nearest(rows, rows.where("is_reference"), block=7)
    plan = found._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") == 0
    held = [i for i in range(300) if i % 3 == 0]
    for r in found.collect():
        c = sorted((round(float(x[r["id"]] @ x[j]), 12) for j in held if j != r["id"]), reverse=True)[:5] if r["id"] < 300 else []
        assert np.allclose(sorted(r["top"], reverse=True), c, rtol=0, atol=2e-12) and len(r["top"]) == len(c)
    assert {r["id"] for r in found.where(F.size("top") == 0).collect()} == {300, 301}
    assert found.count() == 302


@pytest.mark.parametrize("width", [3, 64, 640, 1280])
def test_greatest_of_folded_rows(width):
    x = np.random.default_rng(width).integers(0, 200, (9, width)).astype(float)
    assert np.array_equal(np.sort(ranking.greatest(x, 5), axis=1), np.sort(x, axis=1)[:, -5:])


def test_lists_are_ordered_without_the_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i)] * 4, i / 9, i / 7, None, i % 2 == 0, False, 0, False, None) for i in range(9)], "id long, vector array<double>, cos_dd double, cos_q double, ctx double, direct boolean, eligible boolean, contexts int, influential boolean, recommendation_rank int")
    plan = ranking.ranks(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "vector" in line]
    windowed = plan[plan.index("Window") :]
    assert "vector" not in windowed[: windowed.index("LogicalRDD")]


def test_an_import_of_many_small_shards_is_few_jobs(spark, tmp_path, monkeypatch):
    logged, real = [], files.log_shards
    monkeypatch.setattr(files, "log_shards", lambda s, entries, d: (logged.append(len(entries)), real(s, entries, d)))
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    files.write_snapshot(spark.range(450).select(F.col("id").alias("row_number"), F.col("id").cast("string").alias("id")), source)
    assert files.import_snapshot(spark, source, target, batch_rows=2) == 225
    assert logged == [225]
    assert files.read_snapshot(spark, target).where("shard = row_number div 2").count() == 450


@pytest.mark.parametrize("cap", [8, 1000])
def test_shown_labels_of_a_crowded_plane(spark, monkeypatch, cap):
    monkeypatch.setattr(geometry, "AT_ONCE", 40)
    rnd = random.Random(cap)
    nodes = [(i, i in (3, 5), rnd.randrange(9), 2000 + i % 7, rnd.random() * 0.3 + (i % 9) * 0.4 * (i > 300), rnd.random() * 0.3) for i in range(900)]
    shown = []
    for n in sorted(nodes, key=lambda n: (not n[1], -n[2], -n[3], str(n[0]))):
        if n[1] or all(math.hypot(n[4] - s[4], n[5] - s[5]) >= 0.18 for s in shown):
            shown.append(n)
    frame = spark.createDataFrame(nodes, "id long, is_focal boolean, citations long, year int, x double, y double")
    assert sorted((r["place"], r["id"]) for r in geometry.labelled(frame, cap).collect()) == [(p, n[0]) for p, n in enumerate(shown[:cap], 1)]


def test_shown_labels_never_join_nodes_with_each_other(spark, monkeypatch):
    joined, real = [], geometry.cut
    monkeypatch.setattr(geometry, "cut", lambda d: (joined.append(d._jdf.queryExecution().optimizedPlan().toString()), real(d))[1])
    geometry.labelled(spark.range(200).selectExpr("id", "id = 0 AS is_focal", "id AS citations", "2000 AS year", "id / 1e6 AS x", "0D AS y")).collect()
    assert len(joined) == 1


def test_publication_versions_send_no_side_of_a_join_to_the_driver(spark, monkeypatch):
    plans, real = [], reconcile.cut
    monkeypatch.setattr(reconcile, "cut", lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), real(d))[1])
    found = catalog.QUERIES["publication_versions"](spark, SF)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not [p for p in plans if "Broadcast" in p]


def test_coupled_pairs_are_shuffled_once(spark):
    pairs = textsim.coupling_pairs(spark.range(60).selectExpr("id % 20 AS id", "id % 7 AS ref"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Aggregate")]
