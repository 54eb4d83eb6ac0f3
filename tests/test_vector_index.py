"""The stored vector index beside exact search by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.sources import vector_index as VI

WIDTH = 48


def clustered(n, seed=0):
    """Vectors around many centres, as encoders give them; some equal, so that there are ties."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, WIDTH))
    x = centres[rng.integers(60, size=n)] + 0.7 * rng.standard_normal((n, WIDTH))
    x[n // 2 : n // 2 + 20] = x[0]
    return x


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    x = clustered(6000)
    rows = [(f"p{(7 * i) % 6000:05d}", i, v.tolist()) for i, v in enumerate(x)]
    store = spark.createDataFrame(rows, "id string, row_idx long, vector array<double>").repartition(5)
    path = str(tmp_path_factory.mktemp("index")) + "/v"
    VI.write(store, path, WIDTH)
    return x, store, path


def codes_of(index, spark):
    rows = index.table(spark).orderBy("row_idx").select("row_idx", "id", "codes").collect()
    x = VI.decoded(np.array([r["codes"] for r in rows]), np.array(index.ranges))
    return np.array([r["row_idx"] for r in rows]), [r["id"] for r in rows], x


def plain(q, unit, rows, ids, k, shortlist=None, signs=None):
    score = np.clip(unit @ (q / np.linalg.norm(q)), -1, 1)
    pick = np.arange(len(rows))
    if shortlist is not None:
        distance = (signs != (q > 0)).sum(axis=1)
        pick = np.lexsort((rows, distance))[:shortlist]
    best = pick[np.lexsort((rows[pick], -score[pick]))[:k]]
    return [(int(rows[i]), ids[i], round(float(score[i]), 9)) for i in sorted(best, key=lambda i: (-score[i], ids[i]))]


@pytest.mark.parametrize("prefilter", [True, False])
@pytest.mark.parametrize("block", [1 << 21, 8 * WIDTH * 9])
def test_search_is_a_plain_search(spark, built, monkeypatch, prefilter, block):
    monkeypatch.setattr(VI, "BLOCK_BYTES", block)
    x, store, path = built
    index = VI.opened(spark, path)
    assert index.signs and index.rows == 6000
    rows, ids, unit = codes_of(index, spark)
    signs = unit > 0
    queries = store.where("row_idx % 300 = 0").select(F.col("row_idx").alias("query"), "vector")
    found = {}
    for r in VI.search(index, queries, 15, prefilter, multiplier=8, floor=100).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r["row_idx"], r["id"], round(r["score"], 9)))
        assert r["rank"] == len(found[r["query"]])
    assert sorted(found) == list(range(0, 6000, 300))
    for q, got in found.items():
        expected = plain(x[q], unit, rows, ids, 15, 120 if prefilter else None, signs)
        assert [g[2] for g in got] == [e[2] for e in expected] and ({g[0] for g in got} == {e[0] for e in expected})


def test_recall_of_the_prefilter(spark, built):
    _, store, path = built
    index = VI.opened(spark, path)
    queries = store.where("row_idx % 50 = 0").select(F.col("row_idx").alias("query"), "vector")
    near, all_ = VI.search(index, queries, 20), VI.search(index, queries, 20, prefilter=False)
    hits, wanted = VI.recall(near, all_).agg(F.sum("hits"), F.sum("wanted")).first()
    assert wanted == 120 * 20 and hits / wanted >= 0.9


def test_eligible_rows_are_cut_before_the_search(spark, built):
    x, store, path = built
    index = VI.opened(spark, path)
    some = store.where("row_idx % 7 = 3").select("id")
    queries = store.where("row_idx = 0").select(F.col("row_idx").alias("query"), "vector")
    found = VI.search(index, queries, 10, prefilter=False, eligible=some).collect()
    assert len(found) == 10 and all(r["row_idx"] % 7 == 3 for r in found)
    assert len(VI.search(index, queries, 10, eligible=some.limit(3)).collect()) == 3


def test_an_index_that_isn_t_whole(spark, built, tmp_path):
    _, store, path = built
    with pytest.raises(Exception):
        VI.opened(spark, str(tmp_path / "none"))
    table, bare = spark.read.parquet(f"{path}/codes"), str(tmp_path / "bare")
    manifest = spark.read.json(f"{path}/manifest")
    table.drop("signs").write.parquet(f"{bare}/codes")
    manifest.coalesce(1).write.json(f"{bare}/manifest")
    without = VI.opened(spark, bare)
    assert not without.signs
    queries = store.where("row_idx % 1500 = 0").select(F.col("row_idx").alias("query"), "vector")
    whole = VI.search(VI.opened(spark, path), queries, 5, prefilter=False).orderBy("query", "rank").collect()
    assert VI.search(without, queries, 5).orderBy("query", "rank").collect() == whole
    mended = str(tmp_path / "mended")
    VI.rebuilt(spark, bare, mended)
    again = VI.opened(spark, mended)
    assert again.signs and again.table(spark).select("row_idx", "signs").exceptAll(table.select("row_idx", "signs")).count() == 0
    short = str(tmp_path / "short")
    table.where("row_idx > 0").write.parquet(f"{short}/codes")
    manifest.coalesce(1).write.json(f"{short}/manifest")
    with pytest.raises(ValueError):
        VI.opened(spark, short)


def test_odd_vectors_and_queries(spark, tmp_path):
    rows = [("a", 0, [1.0, 0.0]), ("b", 1, None), ("c", 2, [1.0]), ("d", 3, [float("nan"), 1.0]), ("e", 4, [0.0, 0.0]), ("f", 5, [1.0, 0.5]), (None, 6, [0.5, 1.0])]
    path = str(tmp_path / "i")
    VI.write(spark.createDataFrame(rows, "id string, row_idx long, vector array<double>"), path, 2)
    index = VI.opened(spark, path)
    assert index.rows == 3
    ask = lambda v: VI.search(index, spark.createDataFrame([(1, v)], "query long, vector array<double>"), 5)
    assert [r["row_idx"] for r in ask([1.0, 0.0]).orderBy("rank").collect()] == [0, 5, 6]
    with pytest.raises(Exception, match="width"):
        ask([1.0]).collect()
    with pytest.raises(ValueError):
        VI.search(index, spark.createDataFrame([], "query long, vector array<double>"), 0)
    assert VI.search(index, spark.createDataFrame([], "query long, vector array<double>"), 3).collect() == []
    empty = str(tmp_path / "empty")
    VI.write(spark.createDataFrame([], "id string, row_idx long, vector array<double>"), empty, 2)
    assert VI.search(VI.opened(spark, empty), spark.createDataFrame([(1, [1.0, 0.0])], "query long, vector array<double>"), 3).collect() == []
