"""Slots of gathered papers: limits, repeats, nulls and empty tables."""

from pyspark.sql import functions as F

from kinweave.operators import gathering


def slots(spark, cited, citing, most, references=10, citers=10):
    kind = "id string, pos int, relation string"
    tables = [spark.createDataFrame([(i, n, "extra") for n, i in enumerate(ids)], kind) for ids in (cited, citing)]
    return [tuple(r) for r in gathering.citation_slots(*tables, F.lit("f"), most, references, citers).orderBy("slot").collect()]


def test_references_come_before_citers(spark):
    found = slots(spark, ["a", "f", None, "b", "a", "c"], ["c", "x", "a", "y"], 20)
    assert found == [("f", "focal", 0), ("a", "both", 1), ("b", "reference", 2), ("c", "both", 3), ("x", "citation", 4), ("y", "citation", 5)]


def test_citers_take_what_references_leave(spark):
    assert [r[0] for r in slots(spark, ["a", "b"], ["x", "y", "z"], 4)] == ["f", "a", "b", "x"]
    assert [r[0] for r in slots(spark, ["a", "b", "c"], ["x", "y"], 20, references=1, citers=1)] == ["f", "a", "x"]
    assert slots(spark, ["a"], ["x"], 1) == [("f", "focal", 0)]
    assert slots(spark, [], [], 5) == [("f", "focal", 0)]


def test_recommended_papers_need_texts(spark):
    rows = [("a", "t", "x", 5), ("a", "t", "x", 2), ("b", " ", "x", 0), ("c", "t", None, 1), ("f", "t", "x", 3), (None, "t", "x", 4), ("d", "t", "x", 1), ("e", "t", "x", 9)]
    table = spark.createDataFrame(rows, "id string, title string, abstract string, pos int")
    assert [tuple(r) for r in gathering.recommendation_slots(table, F.lit("f"), 3).orderBy("slot").collect()] == [("f", 0), ("d", 1), ("a", 2)]
    assert [tuple(r) for r in gathering.recommendation_slots(table.where("false"), F.lit("f"), 3).collect()] == [("f", 0)]
