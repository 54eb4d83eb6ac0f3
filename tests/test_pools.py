"""Candidate pools and drawn positions on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import geometry, pool


#: Which way four edges bend.
CURVES = [-1.0, 1.0, -1.0, 1.0]


def test_budgets_and_coverage(spark):
    assert pool.budget(spark, 400) == {"references": 100, "citations": 200, "recommendations": 100}
    assert pool.budget(spark, 2) == {"references": 1, "citations": 0, "recommendations": 1}
    rows = [(None, 5), ("all", None), ("all", 5), ("newest:5", 5), ("newest:9", 5), ("newest:3", 5), ("newest:3", None), ("7", 7)]
    found = spark.createDataFrame(rows, "stored string, wanted int").select(pool.coverage(F.col("stored"), F.col("wanted"))).collect()
    assert [r[0] for r in found] == ["incompatible", "exact", "covers", "exact", "covers", "extends", "extends", "incompatible"]


def test_sources_are_united_once(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "id int, pos int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, pos int")
    rows = {r["id"]: (r["first"]["n"], r["first"]["pos"], r["sources"]) for r in pool.united({"a": a, "b": b}).collect()}
    assert rows == {1: (0, 1, ["a"]), 2: (0, 2, ["a", "b"]), 3: (1, 2, ["b"])}
    assert [r["id"] for r in pool.admitted(pool.united({"a": a, "b": b}), F.col("id") != 1, 1).collect()] == [2]


def test_unavailable_sources(spark):
    status = lambda rows: spark.createDataFrame(rows, "source string, state string, papers int")
    assert pool.require_available(status([("references", "unavailable", 0), ("citations", "empty", 0)])) == ["references"]
    assert pool.require_available(status([("references", "unavailable", 0), ("arxiv_references", "complete", 3)])) == []
    with pytest.raises(pool.SourcesUnavailable):
        pool.require_available(status([("references", "unavailable", 0), ("arxiv_references", "empty", 0)]))


def test_enrichment_stops_at_conflicts(spark):
    corpus = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, None, "own")], "id int, doi string, venue string")
    provider = spark.createDataFrame([(1, "x", "v"), (2, "z", "w"), (3, "q", "r")], "id int, doi string, venue string")
    rows = {r["id"]: r["venue"] for r in pool.enriched(corpus, provider, ["venue"], F.col("doi") != F.col("p_doi")).collect()}
    assert rows == {1: "v", 2: None, 3: "own"}


def test_positions(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 4.0, 2.0)], "id string, x double, y double")
    assert {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in geometry.normalized(p, 0.0).collect()} == {"a": (-1.0, -0.5), "b": (1.0, 0.5)}
    assert geometry.emptiest_corner(p).first()["corner"] == "lower_right"

    df = spark.createDataFrame([("a", "b"), ("zeta", "alpha"), ("x1", "x2"), ("m", "m|")], "a string, b string")
    assert [r[0] for r in df.select(geometry.curve(F.col("a"), F.col("b"))).collect()] == CURVES
    nodes = spark.createDataFrame([("f", True, 0, 0, 0.0, 0.0), ("g", False, 9, 2000, 0.01, 0.0), ("h", False, 5, 2000, 0.9, 0.9)], "id string, is_focal boolean, citations int, year int, x double, y double")
    assert [r["id"] for r in geometry.labelled(nodes).orderBy("place").collect()] == ["f", "h"]


def test_labels_are_those_of_a_walk(spark):
    rnd = random.Random(3)
    rows = [(i, i == 7, rnd.randint(0, 9), 2000, rnd.random(), rnd.random()) for i in range(120)]
    chosen = []
    for r in sorted(rows, key=lambda r: (not r[1], -r[2], -r[3], str(r[0]))):
        if r[1] or all(math.dist(r[4:], c[4:]) >= 0.18 for c in chosen):
            chosen.append(r)
    df = spark.createDataFrame(rows, "id int, is_focal boolean, citations int, year int, x double, y double")
    assert [r["id"] for r in geometry.labelled(df, 100).orderBy("place").collect()] == [r[0] for r in chosen]
