"""Rules of records, graphs and collections, each broken once."""

import json

import pytest
from pyspark.sql import functions as F

from kinweave.operators import contracts as C

GRAPHS, NODES, EDGES = "graph string, focal string, strategy string, nodes long, edges long", "graph string, id string", "graph string, left string, right string, weight double"


def found(df):
    return {(r[0], r["rule"]): (r["broken"], r["first"]) for r in df.collect()}


def test_each_rule_of_graphs(spark):
    graphs = [("ok", "a", "s", 3, 2), ("odd", "z", " s", 5, 7), ("none", "a", "s", 0, 0)]
    nodes = [("ok", i) for i in "abc"] + [("odd", i) for i in ("a", "b", "b", " c", "")] + [("extra", "x")]
    edges = [("ok", "a", "b", 0.5), ("ok", "b", "c", 1.0), ("odd", "a", "q", 0.5), ("odd", "b", "a", 0.5), ("odd", "a", "b", 0.5), ("odd", "a", "a", 0.1), ("odd", "a", " c", 1.5), ("odd", "b", " c", None)]
    got = found(C.graph_violations(spark.createDataFrame(graphs, GRAPHS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)))
    assert got == {
        ("odd", "node id isn't canonical"): (2, ""), ("odd", "node id stands more than once"): (1, "b"), ("odd", "edge has no node"): (1, "q"), ("odd", "focal record isn't a node"): (1, "z"), ("none", "focal record isn't a node"): (1, "a"),
        ("odd", "edge is a loop"): (1, "a - a"), ("odd", "edge stands more than once"): (1, "a - b"), ("odd", "weight isn't between 0 and 1"): (2, " c - a"), ("extra", "graph isn't stated"): (1, "extra"),
        ("odd", "strategy isn't canonical"): (1, "odd"), ("odd", "edges aren't as many as stated"): (1, "odd"),
    }
    with pytest.raises(ValueError, match="edge has no node"):
        C.require(C.graph_violations(spark.createDataFrame(graphs, GRAPHS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)), "graphs")
    C.require(C.graph_violations(*(spark.createDataFrame([r for r in rows if r[0] == "ok"], kind) for rows, kind in ((graphs, GRAPHS), (nodes, NODES), (edges, EDGES)))), "graphs")


GOOD = {"paperId": "p", "title": "T", "abstract": "A", "year": 2020, "citationCount": 3, "authors": [{"name": " Ada ", "authorId": "1"}, {"name": "", "authorId": None}], "externalIds": {"DOI": "10.1/X", "ArXiv": "2101.00001"}}


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({}, None), ({"title": 5}, "title isn't text"), ({"title": 0}, None), ({"title": None, "abstract": None, "year": None, "citationCount": None, "authors": None}, None), ({"year": "2020"}, "year isn't a whole number"), ({"year": True}, "year isn't a whole number"),
        ({"year": 2020.5}, "year isn't a whole number"), ({"citationCount": "3"}, "citationCount isn't a whole number"), ({"citationCount": True}, "citationCount isn't a whole number"), ({"citationCount": False}, None), ({"abstract": ["x"]}, "abstract isn't text"),
        ({"authors": "Ada"}, "authors aren't a list"), ({"authors": ["Ada"]}, "an author isn't as it should be"), ({"authors": [{"name": "A", "authorId": 5}]}, "an author isn't as it should be"), ({"authors": [{"authorId": "5"}]}, "an author isn't as it should be"),
    ],
)
def test_kinds_of_provider_fields(spark, change, fault):
    (row,) = C.typed_records(spark.createDataFrame([(json.dumps(GOOD | change),)], "payload string")).collect()
    assert row["fault"] == fault and (row["record"] is None) == (fault is not None)


def test_strict_records(spark):
    rows = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps({"title": 5}),), (json.dumps(GOOD | {"paperId": 7}),), (json.dumps({"paperId": "q", "citationCount": -4}),)], "payload string")
    assert [tuple(r) for r in C.strict_records(rows).orderBy("id").collect()] == [("p", "T", "A", 2020, 3, ["Ada"], "10.1/x", "2101.00001"), ("q", "Unknown", "", None, 0, [], None, None)]
    with pytest.raises(Exception, match="year isn't a whole number"):
        C.strict_records(spark.createDataFrame([(json.dumps(GOOD | {"year": "x"}),)], "payload string")).collect()
    with pytest.raises(Exception, match="isn't an object"):
        C.strict_records(spark.createDataFrame([("[1",)], "payload string")).collect()


def test_collections(spark):
    good = {"kind": "c", "version": 2, "current": "s:a", "results": [{"result_id": "s:a", "focal": "a", "strategy": "s", "title": "new", "updated": "2024-01-01T00:00:00Z"}, {"result_id": "s:a", "focal": "a", "strategy": "s", "title": "old", "updated": "2023-01-01T00:00:00Z"}]}
    bad = {"kind": "d", "version": 1, "current": "x", "results": [{"result_id": " s:b", "focal": "", "strategy": "s", "title": "t", "updated": "soon"}]}
    rows = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("none", "{}")], "package string, body string").select("package", F.from_json("body", C.COLLECTION).alias("b")).select("package", "b.*")
    got = found(C.collection_violations(rows, "c", 2))
    assert {k for k in got if k[0] == "good"} == set()
    assert {k[1] for k in got if k[0] == "bad"} == {"kind isn't known", "version isn't known", "current result isn't there", "result_id isn't canonical", "focal isn't canonical", "result_id isn't strategy and focal record", "updated isn't a time"}
    assert {k[1] for k in got if k[0] == "none"} == {"kind isn't known", "version isn't known", "results aren't a list"}
    assert [(r["result_id"], r["title"]) for r in C.collection_results(rows.where("package = 'good'")).collect()] == [("s:a", "new")]


def test_contracts_and_parameters():
    C.require_contract({"model": "m", "size": 3}, {"size": 3, "model": "m"})
    with pytest.raises(ValueError, match="size is 3, not 4"):
        C.require_contract({"model": "m", "size": 3}, {"model": "m", "size": 4})
    assert C.differing({"a": 1}, {"b": 1}) == ["a", "b"] and C.unit_interval("0.5", "x") == 0.5 and C.bounded(" 7 ", "x", 1) == 7
    for wrong in ("a", 2, -0.1, float("nan"), True, None):
        with pytest.raises(ValueError):
            C.unit_interval(wrong, "x")
    for wrong in (0, 11, "x", 1.5, True, None):
        with pytest.raises(ValueError):
            C.bounded(wrong, "x", 1, 10)
